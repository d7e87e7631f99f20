"""Table operations with data-frame semantics for missing values: merge, filter, score, rank, validate.

Missing join keys match each other, NaN counts as missing, missing values sort last in both directions, and a missing
flag is false. Arguments are checked when the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.session import cut

Transform = Callable[..., DataFrame]
#: Scorers, validators and transforms by the path that callers write, module:function.
HOOKS: dict[str, Transform] = {}
CONDITIONS = ("equals", "greater_than", "less_than", "contains")


def checked_path(name: str) -> str:
    if ":" not in name:
        raise ValueError(f"{name!r} is not of the form module:function")
    return name


def hook(name: str):
    """Register a scorer, validator or transform under a path."""

    def keep(fn: Transform) -> Transform:
        HOOKS[checked_path(name)] = fn
        return fn

    return keep


def resolved(fn: Transform | str | None, what: str) -> Transform:
    """The function itself, or the registered one of that path; nothing is imported by name."""
    if not fn:
        raise ValueError(f"{what} is required")
    if callable(fn):
        return fn
    if checked_path(fn) not in HOOKS:
        raise ValueError(f"no function {fn!r}; registered: {sorted(HOOKS)}")
    return HOOKS[fn]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    kind = df.schema[name].dataType
    return F.nanvl(df[name], F.lit(None).cast(kind)) if isinstance(kind, (T.DoubleType, T.FloatType)) else df[name]


def _numbers(df: DataFrame, name: str) -> Column:
    """Whether a value isn't NaN, true for columns that can't hold one."""
    return ~F.isnan(name) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else F.lit(True)


def _need(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"no column {name!r} among {df.columns}")


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    for side in (left, right):
        _need(side, *keys)
    both = [c for c in left.columns if c in right.columns and c not in keys]
    a = left.select(*(F.col(c).alias(f"{c}_x" if c in both else c) for c in left.columns))
    b = right.select(*(F.col(c).alias(f"__r_{c}" if c in keys else f"{c}_y" if c in both else c) for c in right.columns))
    # NaN and null are one missing key, whichever of them a side has.
    match = reduce(Column.__and__, (present(a, k).eqNullSafe(present(b, f"__r_{k}")) for k in keys))
    merged = a.join(b, match, how)
    own = [F.coalesce(a[k], b[f"__r_{k}"]).alias(k) if how == "full" else a[k] for k in keys]
    return merged.select(*own, *(c for c in a.columns if c not in keys), *(c for c in b.columns if not c.startswith("__r_")))


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name with duplicates; absent columns are null, and columns of clashing types become text."""
    kinds: dict[str, set] = {}
    for f in frames:
        for field in f.schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType)
    clash = {n for n, k in kinds.items() if len(k) > 1 and not all(isinstance(x, T.NumericType) for x in k)}
    frames = [f.select(*(F.col(c).cast("string").alias(c) if c in clash else F.col(c) for c in f.columns)) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge(frames: Sequence[DataFrame], strategy: str = "concat", on: str | Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """N frames into one: concat, inner_join or outer_join, folded from the left. An unknown strategy is a concat.

    inner_join without keys takes the first column of the first frame that all have, and is a concat without one.
    """
    if not frames:
        return (spark or SparkSession.getActiveSession()).createDataFrame([], T.StructType([]))
    if len(frames) == 1:
        return frames[0]
    keys = [on] if isinstance(on, str) else list(on or [])
    if strategy == "outer_join" and not keys:
        raise ValueError("outer_join needs merge keys")
    if strategy == "inner_join" and not keys:
        keys = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])][:1]
    if strategy in ("inner_join", "outer_join") and keys:
        how = "inner" if strategy == "inner_join" else "full"
        return reduce(lambda a, b: _joined(a, b, keys, how), frames)
    return concat(frames)


def filter_by(df: DataFrame, column: str, condition: str, value) -> DataFrame:
    _need(df, column)
    if condition not in CONDITIONS:
        raise ValueError(f"unknown condition {condition!r}; one of {CONDITIONS}")
    c = F.col(column)
    # Plain comparisons, which drop nulls and reach the scan; NaN lies above all numbers.
    test = {"equals": lambda: c == value, "greater_than": lambda: c > value, "less_than": lambda: c < value, "contains": lambda: c.cast("string").rlike(value)}
    return df.where(test[condition]()).where(_numbers(df, column) if condition != "less_than" else F.lit(True))


def rank_by(df: DataFrame, column: str, ascending: bool = False, top: int | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Sorted, missing values last; with `top`, a top-k that never sorts the whole table."""
    _need(df, column, *tiebreak)
    c = present(df, column)
    ranked = df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *(F.col(t).asc_nulls_last() for t in tiebreak))
    return ranked if top is None else ranked.limit(top)


def above(df: DataFrame, threshold: float = 0.0, column: str = "score") -> DataFrame:
    _need(df, column)
    return df.where(F.col(column) >= threshold).where(_numbers(df, column))


def score_and_rank(df: DataFrame, scorer: Transform | str | None, threshold: float = 0.0, max_results: int | None = None, tiebreak: Sequence[str] = (), embeddings: DataFrame | None = None, on: str | None = None, **params) -> DataFrame:
    """Rows with a score from the threshold on, best first. embeddings, if given, are joined to the rows by the column `on` before
    the scorer sees them, and their columns leave again with it."""
    score = resolved(scorer, "scoring_function")
    given = df if embeddings is None else _joined(df, embeddings, [on], "left")
    scored = given.transform(score, **params)
    _need(scored, "score")
    if embeddings is not None:
        scored = scored.drop(*(c for c in embeddings.columns if c != on and c not in df.columns))
    return rank_by(above(scored, threshold), "score", top=max_results, tiebreak=tiebreak)


def unit_interval(*parts: Column) -> Column:
    """A number from 0 to 1 by the hash of what is given, the same on all engines that have MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def simulated_scores(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A uniform score by hash of a key, the same however the rows are dealt out, marked as simulated."""
    return df.withColumn("score", unit_interval(F.lit(str(seed)), F.col(key).cast("string"))).withColumn("score_simulated", F.lit(True))


def transform(df: DataFrame, fn: Transform | str | None, what: str = "transform_function", **params) -> DataFrame:
    out = df.transform(resolved(fn, what), **params)
    if not isinstance(out, DataFrame):
        raise TypeError("a transform returns a DataFrame")
    return out


def validate(df: DataFrame, validator: Transform | str | None, mode: str = "strict", once: bool = False, **params) -> tuple[DataFrame, DataFrame]:
    """-> (passed, flagged). strict: rows with any true *_flag are flagged. Any other mode keeps all rows.

    once: the validator's rows are written before they are split, for one that is slow or draws at random.
    """
    checked = transform(df, validator, "filter_function", **params)
    flags = [c for c in checked.columns if c.endswith("_flag")]
    if not flags:
        raise ValueError("the validator gave no flag column")
    if mode != "strict":
        return checked, checked.where(F.lit(False))
    checked = cut(checked) if once else checked
    bad = reduce(Column.__or__, (F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in flags))
    return checked.where(~bad), checked.where(bad)


def finite(array: str, least: int = 1) -> Column:
    """Whether an array has values and all are finite."""
    ok = F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(array) >= least) & ok, F.lit(False))


def finite_matrix(rows: str, columns: int | None = None) -> Column:
    """Whether an array of arrays has rows of one length, the given one if there is one, and only finite numbers."""
    width = F.lit(columns) if columns else F.size(F.get(F.col(rows), F.lit(0)))
    ok = F.forall(rows, lambda r: (F.size(r) == width) & F.forall(r, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return F.coalesce((F.size(rows) > 0) & (width > 0) & ok, F.lit(False))


def contract_violation(df: DataFrame, success: str = "success", summary: str = "summary", files: str = "output_files") -> Column:
    """What is wrong with an adapter's result first: a column that is absent, of the wrong type, or null; else null."""
    wanted = ((success, T.BooleanType), (summary, T.StringType), (files, (T.MapType, T.StructType)))
    found = []
    for name, kind in wanted:
        if name not in df.columns:
            found.append(F.lit(f"missing {name}"))
        elif not isinstance(df.schema[name].dataType, kind):
            found.append(F.lit(f"{name} is {df.schema[name].dataType.simpleString()}"))
        else:
            found.append(F.when(F.col(name).isNull(), F.lit(f"missing {name}")))
    return F.coalesce(*found)


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """The product of parameter lists, one row a job; a design is written by hand, so the driver makes it."""
    kinds = {bool: "boolean", str: "string", int: "bigint", float: "double"}
    schema = ", ".join(f"{name} {kinds[type(vs[0])]}" for name, vs in values.items())
    return spark.createDataFrame(list(product(*values.values())), schema)


def dedupe_registry(entries: DataFrame) -> DataFrame:
    """(name, file, source): one file a name; the one whose stem is the name wins, then the first by path."""
    stem = F.regexp_extract("file", r"([^/]+)\.ya?ml$", 1)
    best = F.min(F.struct((stem != F.col("name")).alias("other"), F.col("file"), F.col("source")))
    return entries.groupBy("name").agg(best.alias("b")).select("name", "b.file", "b.source")
