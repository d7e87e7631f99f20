"""Measured vectors and trajectories as rows: their schema, consistency, arrays, JSON and changes.

A vector has the four core numbers and a map of outcomes by metric. Only an outcome that is measured makes a number a
measurement; numbers of other outcomes are padding. A vector without outcomes, as older records are, is unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.geometry import CORE, WHOLE

OUTCOME = "struct<status: string, value: double, reason: string>"
VECTOR = "struct<" + ", ".join(f"{m}: {'bigint' if m in WHOLE else 'double'}" for m in CORE) + f", measurements: map<string, {OUTCOME}>>"
TRAJECTORY = (
    f"struct<id: string, workflow: array<struct<algorithm: string, params: map<string, string>>>, dataset_name: string, g_vectors: array<{VECTOR}>, "
    "executed_at: string, total_time_seconds: double, per_step_times: array<double>, embedding_paths: array<string>>"
)


def vectors(measurements: DataFrame, *keys: str) -> DataFrame:
    """Long rows (keys, metric, status, value, reason) -> keys and `vector`; core metrics without a row were not requested."""
    outcome = F.struct("status", F.col("value").cast("double").alias("value"), "reason")
    rows = measurements.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", outcome.alias("outcome"))))).alias("known"))
    absent = F.struct(F.lit("not_requested").alias("status"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("reason"))
    core = F.map_from_arrays(F.array(*map(F.lit, CORE)), F.array(*(absent for _ in CORE)))
    every = F.map_concat(F.map_filter(core, lambda k, _: ~F.array_contains(F.map_keys("known"), k)), "known")
    number = lambda m: F.coalesce(F.when(F.col("all")[m]["status"] == "measured", F.col("all")[m]["value"]), F.lit(0.0)).cast("bigint" if m in WHOLE else "double").alias(m)
    return rows.withColumn("all", every).select(*keys, F.struct(*(number(m) for m in CORE), F.col("all").alias("measurements")).cast(VECTOR).alias("vector"))


def of_numbers(numbers: Column) -> Column:
    """A vector of an array in the order of CORE, all measured; an error if it isn't four numbers."""
    four = F.when(F.size(numbers) == len(CORE), numbers).otherwise(F.raise_error(F.concat(F.lit("expected 4 numbers, got "), F.size(numbers).cast("string"))).cast("array<double>"))
    value = lambda i: F.get(four, F.lit(i)).cast("bigint" if CORE[i] in WHOLE else "double")
    outcome = lambda i: F.struct(F.lit("measured").alias("status"), value(i).cast("double").alias("value"), F.lit(None).cast("string").alias("reason"))
    known = F.map_from_arrays(F.array(*map(F.lit, CORE)), F.array(*map(outcome, range(len(CORE)))))
    return F.struct(*(value(i).alias(m) for i, m in enumerate(CORE)), known.alias("measurements"))


def loaded(vector: Column) -> Column:
    """A record as read: without outcomes all core metrics are unknown, whatever their numbers."""
    unknown = F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("reason"))
    core = F.map_from_arrays(F.array(*map(F.lit, CORE)), F.array(*(unknown for _ in CORE)))
    return vector.withField("measurements", F.coalesce(vector["measurements"], core))


def inconsistent(vector: Column) -> Column:
    """What is wrong with a vector, or null: a measured value that isn't finite, or not that of its field."""
    known = lambda m: vector["measurements"][m]
    measured = lambda o: F.coalesce(o["status"] == "measured", F.lit(False))
    unfit = F.filter(F.map_entries(vector["measurements"]), lambda e: measured(e["value"]) & (e["value"]["value"].isNull() | F.isnan(e["value"]["value"]) | (F.abs(e["value"]["value"]) == float("inf"))))
    fields = [F.when(measured(known(m)) & (vector[m].cast("double") != known(m)["value"]), F.lit(f"metric {m} has inconsistent numeric field and measurement")) for m in CORE]
    return F.coalesce(F.when(F.size(unfit) > 0, F.concat(F.lit("metric "), F.get(unfit, F.lit(0))["key"], F.lit(" must have a finite measured value"))), *fields)


def unavailable(vector: Column, metric: str) -> Column:
    """Why a vector has no value of a metric, or null where it has one."""
    outcome = vector["measurements"][metric]
    status = F.coalesce(outcome["status"], F.lit("not_requested"))
    return (
        F.when(status == "failed", F.concat(F.lit(f"metric {metric} failed: "), F.coalesce(outcome["reason"], F.lit(""))))
        .when(status == "not_requested", F.lit(f"metric {metric} was not requested"))
        .when(status == "unknown", F.lit(f"metric {metric} has unknown legacy provenance"))
        .when(status != "measured", F.concat(F.lit(f"invalid measurement status for {metric}: "), status))
    )


def incomplete(vector: Column) -> Column:
    """Why a vector can't enter arithmetic, or null: it is inconsistent, a request failed, or a core metric is missing."""
    failed = F.filter(F.map_entries(vector["measurements"]), lambda e: e["value"]["status"] == "failed")
    first = F.when(F.size(failed) > 0, F.concat(F.lit("metric "), F.get(failed, F.lit(0))["key"], F.lit(" failed: "), F.coalesce(F.get(failed, F.lit(0))["value"]["reason"], F.lit(""))))
    return F.coalesce(inconsistent(vector), first, *(unavailable(vector, m) for m in CORE))


def to_array(vector: Column, strict: bool = True) -> Column:
    """The four core values in the order of CORE; where they aren't complete an error, or null if not strict."""
    reason = incomplete(vector)
    values = F.array(*(vector["measurements"][m]["value"] for m in CORE))
    return F.when(reason.isNull(), values).otherwise(F.raise_error(reason).cast("array<double>") if strict else F.lit(None).cast("array<double>"))


def vector_json(vector: Column) -> Column:
    return F.to_json(vector)


def vector_from_json(text: Column) -> Column:
    return loaded(F.from_json(text, VECTOR, {"mode": "FAILFAST"}))


def trajectory_json(trajectory: Column) -> Column:
    return F.to_json(trajectory)


def trajectory_from_json(text: Column) -> Column:
    read = F.from_json(text, TRAJECTORY, {"mode": "FAILFAST"})
    return read.withField("g_vectors", F.transform(read["g_vectors"], loaded))


def executed_at(trajectory: Column) -> Column:
    """The ISO date and time as a timestamp."""
    return F.to_timestamp(trajectory["executed_at"])


def vector_deltas(trajectory: Column) -> Column:
    """array<struct<core metrics>>: changes from each vector to the next; an error where one of them is incomplete."""
    arrays = F.transform(trajectory["g_vectors"], lambda v: to_array(v))
    steps = F.transform(F.slice(arrays, F.lit(2), F.greatest(F.size(arrays) - 1, F.lit(0))), lambda now, i: F.struct(now.alias("now"), F.get(arrays, i).alias("before")))
    return F.transform(steps, lambda s: F.struct(*((F.get(s["now"], F.lit(i)) - F.get(s["before"], F.lit(i))).alias(m) for i, m in enumerate(CORE))))


def scores() -> Column:
    """The number of a metric's answer for display: column `answer` struct<status, scalar, per_sample>: an unmeasured
    one has none, a pair gives its number, samples alone their mean."""
    a = F.col("answer")
    mean = F.when(F.size(a["per_sample"]) > 0, F.aggregate(a["per_sample"], F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a["per_sample"]), F.lit(1)))
    return F.when(F.coalesce(a["status"], F.lit("measured")) == "measured", F.coalesce(a["scalar"], mean))


OUTPUT_FIELDS = ("label", "metadata", "scores")


def checked_outputs(outputs: DataFrame) -> DataFrame:
    """Embedding outputs have a column `embeddings` of arrays; other columns are free."""
    if "embeddings" not in outputs.columns:
        raise ValueError("embedding outputs have no column embeddings")
    kind = outputs.schema["embeddings"].dataType.simpleString()
    if not kind.startswith("array<"):
        raise ValueError(f"embeddings are {kind}, not arrays")
    return outputs


def merged_outputs(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """base with the columns of more, joined by key: they replace columns of the same name, but never the embeddings."""
    added = [c for c in more.columns if c not in (key, "embeddings")]
    kept = [c for c in checked_outputs(base).columns if c not in added]
    return base.select(*kept).join(more.select(key, *added), key, "left")


def geometric_features(outputs: DataFrame, key: str, with_scores: bool = True, with_metadata: bool = False) -> DataFrame:
    """key, embeddings, and as geometric_metrics and geometric_metadata what was asked for and is there, then free columns."""
    named = {"scores": "geometric_metrics"} if with_scores else {}
    named |= {"metadata": "geometric_metadata"} if with_metadata else {}
    free = [c for c in checked_outputs(outputs).columns if c not in (key, "embeddings", *OUTPUT_FIELDS)]
    return outputs.select(key, "embeddings", *(F.col(c).alias(n) for c, n in named.items() if c in outputs.columns), *free)


def all_consistent(df: DataFrame, vector: str = "vector") -> DataFrame:
    """df, failing at the first inconsistent vector that is read."""
    reason = inconsistent(F.col(vector))
    return df.withColumn(vector, F.when(reason.isNull(), F.col(vector)).otherwise(F.raise_error(reason).cast(VECTOR)))


def complete_only(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [incomplete(F.col(vector)).isNull()]))
