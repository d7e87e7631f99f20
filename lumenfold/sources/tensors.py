"""Stored tensors of traces as a Python data source: one NumPy archive a trace, one partition a file.

`spark.read.format("trace_tensors").load(folder)` gives the rows of all archives <trace_id>.npz in a folder:

  trace_id, tensor (the array's name), token_idx, layer, state

of arrays of tokens, or of tokens and layers, or of more axes, which are one state then. Halves and doubles come as
single floats. The option `traces`, a JSON list of ids, reads the files of those traces alone. (Filters aren't pushed to
the reader: this version of Spark keeps what one query pushed for the next one of the same frame.) Files are listed and read by Arrow's file
systems, so a folder may be a path or the address of a store that Arrow knows; `by_spark` reads them by Spark's own
readers instead, from any store that Spark reaches.
"""

from __future__ import annotations

import io
import json
import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "trace_tensors"
ROWS = "trace_id string, tensor string, token_idx long, layer int, state array<float>"
SCHEMA = pa.schema([("trace_id", pa.string()), ("tensor", pa.string()), ("token_idx", pa.int64()), ("layer", pa.int32()), ("state", pa.list_(pa.float32()))])
SUFFIX = ".npz"
#: Numbers of a batch of rows.
BATCH = 1 << 20


def batches(trace_id: str, archive: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of one archive, array by array, some tokens at a time."""
    with np.load(io.BytesIO(archive), allow_pickle=False) as arrays:
        for name in sorted(arrays.files):
            x = arrays[name]
            if x.ndim < 2 or not np.issubdtype(x.dtype, np.floating):
                raise ValueError(f"tensor {name!r} of trace {trace_id!r} isn't an array of floats by token")
            tokens, layers, d = len(x), 1 if x.ndim == 2 else x.shape[1], math.prod(x.shape[1 if x.ndim == 2 else 2 :])
            x = x.reshape(tokens, layers, d)
            step = max(1, BATCH // max(1, layers * d))
            for at in range(0, tokens, step):
                own = x[at : at + step].astype(np.float32)
                n = len(own) * layers
                states = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(own.ravel()))
                places = np.repeat(np.arange(at, at + len(own)), layers), np.tile(np.arange(layers, dtype=np.int32), len(own))
                yield pa.RecordBatch.from_arrays([pa.array([trace_id] * n), pa.array([name] * n), pa.array(places[0], pa.int64()), pa.array(places[1], pa.int32()), states.cast(pa.list_(pa.float32()))], schema=SCHEMA)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, folder: str, traces: str | None):
        self.folder, self.ids = folder, None if traces is None else set(json.loads(traces))

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[File]:
        store, path = self._place()
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file and f.path.endswith(SUFFIX))
        return [File(p) for p in found if self.ids is None or _trace_of(p) in self.ids] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with self._place()[0].open_input_file(partition.path) as f:
                yield from batches(_trace_of(partition.path), f.read())


def _trace_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(SUFFIX)


class TraceTensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> Reader:
        if not self.options.get("path"):
            raise ValueError(f"{NAME} reads a folder; give its path")
        return Reader(self.options["path"], self.options.get("traces"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and its code to all workers."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TraceTensors)


def load(spark: SparkSession, folder: str, traces: Sequence[str] | None = None) -> DataFrame:
    """The rows of a folder's archives, or of some traces' alone."""
    register(spark)
    reader = spark.read.format(NAME)
    return (reader if traces is None else reader.option("traces", json.dumps(list(traces)))).load(folder)


def by_spark(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows, by Spark's reader of binary files."""
    register(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "content")

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        for batch in rows:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from batches(_trace_of(unquote(path)), content.as_py())

    return files.mapInArrow(read, ROWS)


def with_states(traces: DataFrame, tensors: DataFrame, tensor: str = "token_level") -> DataFrame:
    """Each trace's rows of one of its tensors beside it: trace's columns, token_idx, layer, state, which are null where
    it has none."""
    own = tensors.where(F.col("tensor") == tensor).select(F.col("trace_id").alias("__of"), "token_idx", "layer", "state")
    return traces.join(own, F.col("trace_id") == F.col("__of"), "left").drop("__of")


def write_archives(states: DataFrame, tensor: str = "token_level", half: bool = True) -> DataFrame:
    """(trace_id, token_idx, layer, state) -> trace_id, archive: the bytes of a trace's archive, states in order of token
    and layer, for tools that read NumPy's files. A trace's states are one group, as its archive is one file."""
    import pandas as pd

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["token_idx", "layer"])
        x = np.stack(own["state"].to_numpy()).reshape(own["token_idx"].nunique(), own["layer"].nunique(), -1)
        out = io.BytesIO()
        np.savez_compressed(out, **{tensor: x.astype(np.float16 if half else np.float32)})
        return pd.DataFrame({"trace_id": [own["trace_id"].iloc[0]], "archive": [out.getvalue()]})

    return states.select(F.col("trace_id").cast("string").alias("trace_id"), "token_idx", "layer", "state").groupBy("trace_id").applyInPandas(pack, "trace_id string, archive binary")
