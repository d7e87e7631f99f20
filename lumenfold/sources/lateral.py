"""Loaders as a table function: a table of sources is read in parallel, a source a row, by a lateral join.

  SELECT s.name, t.* FROM sources s, LATERAL load_rows(s.name, s.loader, s.params, 'id BIGINT, text STRING') t

A loader here is a Python function, registered by name, that takes its parameters and gives frames of pandas, Arrow's
tables or batches, or rows as dictionaries, at once or one after the other. It runs where its row lies, so sources are
read side by side, a frame at a time. The schema is a constant, known while the query is planned: names and types of one
word, or of one array, or a schema's JSON. Columns are matched by name, those that a source lacks are null, and others
are left out.
"""

from __future__ import annotations

import importlib
import json
import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

NAME = "load_rows"
LOADERS: dict[str, Callable[..., object]] = {}


def local_loader(name: str):
    """Register a loader for workers; names are module:function, as callers write them."""
    if ":" not in name:
        raise ValueError(f"{name!r} is not of the form module:function")

    def keep(fn: Callable[..., object]) -> Callable[..., object]:
        LOADERS[name] = fn
        return fn

    return keep


@local_loader("files:dataset")
def files(path: str, format: str = "parquet", columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:  # noqa: A002 - as Arrow names it
    """Files of a format that Arrow reads."""
    return ds.dataset(path, format=format).to_batches(columns=columns)


@local_loader("values:rows")
def rows(rows: list[dict]) -> list[dict]:
    """Rows that stand in the parameters."""
    return rows


def frames(answer: object) -> Iterator[pa.Table]:
    """What a loader gave, as Arrow's tables."""
    if isinstance(answer, pd.DataFrame):
        yield pa.Table.from_pandas(answer, preserve_index=False)
    elif isinstance(answer, pa.Table):
        yield answer
    elif isinstance(answer, pa.RecordBatch):
        yield pa.Table.from_batches([answer])
    elif isinstance(answer, list) and all(isinstance(r, dict) for r in answer):
        yield pa.Table.from_pylist(answer)
    elif isinstance(answer, Iterable) and not isinstance(answer, str | bytes | dict):
        for part in answer:
            yield from frames([part] if isinstance(part, dict) else part)
    else:
        raise TypeError(f"a loader gives frames or rows, not {type(answer).__name__}")


TYPES = {"bigint": T.LongType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def kind(text: str) -> T.DataType:
    text = text.strip().lower()
    if text.startswith("array<") and text.endswith(">"):
        return T.ArrayType(kind(text[6:-1]))
    if text not in TYPES:
        raise ValueError(f"no type {text!r} here; give the schema as JSON")
    return TYPES[text]


def schema_of(text: str) -> T.StructType:
    """A schema from its JSON, or from names and types. The planner's worker has no session to ask."""
    if text.lstrip().startswith("{"):
        return T.StructType.fromJson(json.loads(text))
    pairs = [part.strip().split(None, 1) for part in text.split(",")]
    if any(len(p) != 2 for p in pairs):
        raise ValueError(f"{text!r} isn't a list of names and types")
    return T.StructType([T.StructField(name.strip("`"), kind(own)) for name, own in pairs])


class LoadRows:
    """load_rows(name, loader, params as JSON, schema as DDL)."""

    def __init__(self, analyzed: AnalyzeResult):
        self.schema = to_arrow_schema(analyzed.schema)

    @staticmethod
    def analyze(name: AnalyzeArgument, loader: AnalyzeArgument, params: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
        if not schema.isConstantExpression or not isinstance(schema.value, str):
            raise ValueError("the schema of load_rows is a constant text")
        return AnalyzeResult(schema_of(schema.value))

    def eval(self, name: str, loader: str, params: str, schema: str) -> Iterator[tuple]:
        try:
            if loader not in LOADERS:
                raise ValueError(f"no loader {loader!r}; registered: {sorted(LOADERS)}")
            for table in frames(LOADERS[loader](**json.loads(params or "{}"))):
                columns = [table.column(f.name).cast(f.type).to_pylist() if f.name in table.column_names else [None] * table.num_rows for f in self.schema]
                yield from zip(*columns, strict=True) if columns else ()
        except Exception as error:
            raise RuntimeError(f"source {name!r}: {type(error).__name__}: {error}") from error


def register(spark: SparkSession, *modules: str) -> None:
    """Makes load_rows known to a session, with the loaders that are registered by now and the code of those modules."""
    for module in (__name__, *modules):
        cloudpickle.register_pickle_by_value(importlib.import_module(module) if module != __name__ else sys.modules[__name__])
    spark.udtf.register(NAME, udtf(LoadRows))


def load_all(sources: DataFrame, schema: str, modules: tuple[str, ...] = ()) -> DataFrame:
    """sources (name, loader, params: JSON) -> source and the schema's columns: all sources' rows, which a union of the
    loaders' frames by name would have, read where the rows of `sources` lie."""
    spark = sources.sparkSession
    register(spark, *modules)
    planned = spark.createDataFrame([], schema).schema.json()
    return spark.sql(f"SELECT s.name AS source, t.* FROM {{sources}} s, LATERAL {NAME}(s.name, s.loader, s.params, :planned) t", args={"planned": planned}, sources=sources)
