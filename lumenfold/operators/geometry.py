"""Geometry of state sequences: velocity, curvature, step deltas, measurements with a status, and set metrics.

A measurement is measured, failed, not_requested or unknown; only measured ones have a value and enter arithmetic.
Formulas are those of publications: cosine velocity, Menger curvature, participation ratio of a covariance spectrum,
the maximum-likelihood intrinsic dimension, trustworthiness and continuity of a projection.
"""

from __future__ import annotations

import inspect
import math
import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.vectors import cosine_distance, distance, menger, total
from lumenfold.operators.neighbours import Blocks, neighbours
from lumenfold.session import clean_cut as cut

CORE = ("beta_0", "beta_1", "participation_ratio", "local_intrinsic_dim")
WHOLE = ("beta_0", "beta_1")
NON_FINITE = "ValueError: Metric returned a non-finite value"


def _before(states: DataFrame, steps: int) -> Column:
    return F.lag("state", steps).over(Window.partitionBy("trace_id").orderBy("token_idx"))


def velocity(states: DataFrame) -> DataFrame:
    """(trace_id, token_idx, state) -> cosine distance from the state before; the first of a trace has none."""
    return states.select("trace_id", "token_idx", "state", _before(states, 1).alias("b")).where("b is not null").select("trace_id", "token_idx", cosine_distance(F.col("b"), F.col("state")).alias("velocity"))


def curvature(states: DataFrame) -> DataFrame:
    """Menger curvature over consecutive triples, by the last of each."""
    rows = states.select("trace_id", "token_idx", "state", _before(states, 1).alias("b"), _before(states, 2).alias("a")).where("a is not null")
    return rows.select("trace_id", "token_idx", menger(F.col("a"), F.col("b"), F.col("state")).alias("curvature"))


def mean_of_means(values: DataFrame, value: str) -> DataFrame:
    """Each trace's mean, then their mean; no transition crosses traces."""
    return values.groupBy("trace_id").agg(F.avg(value).alias("m")).agg(F.avg("m").alias(f"mean_{value}"), F.count(F.lit(1)).alias("traces"))


def medians(values: DataFrame, value: str) -> DataFrame:
    return values.groupBy("trace_id").agg(F.median(value).alias(f"median_{value}"))


def measured(value: Column, requested: Column, error: Column | None = None) -> Column:
    """struct<status, value, reason>: failed with a reason where there is an error, or no finite value."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    failure = F.coalesce(error, F.when(~finite, F.lit(NON_FINITE))) if error is not None else F.when(~finite, F.lit(NON_FINITE))
    status = F.when(~requested, "not_requested").when(failure.isNotNull(), "failed").otherwise("measured")
    return F.struct(status.alias("status"), F.when(status == "measured", value).alias("value"), F.when(status == "failed", failure).alias("reason"))


def number(answer: DataFrame) -> Column:
    """A metric's answer as a number: `value` itself, the first of an array `pair`, the mean of an array `samples`."""
    mean = lambda c: F.when(F.size(c) > 0, total(c) / F.greatest(F.size(c), F.lit(1)))
    ways = {"value": lambda c: c.cast("double"), "pair": lambda c: F.get(c, F.lit(0)).cast("double"), "samples": lambda c: mean(F.transform(c, lambda x: x.cast("double")))}
    for name, way in ways.items():
        if name in answer.columns:
            return way(F.col(name))
    raise ValueError(f"a metric's answer has one of the columns {list(ways)}, not {answer.columns}")


def legacy(status: Column) -> Column:
    return F.coalesce(status, F.lit("unknown"))


def required(row_value: Column, status: Column, metric: Column) -> Column:
    """The value, or an error where it is not measured."""
    return F.when(status == "measured", row_value).otherwise(F.raise_error(F.concat(F.lit("measurement unavailable: "), metric, F.lit(" is "), legacy(status))).cast("double"))


def deltas(measurements: DataFrame, strict: bool = True) -> DataFrame:
    """(trajectory_id, step, metric, status, value) -> the change of each core metric from the step before.

    strict: an unmeasured one is an error; otherwise its change is null.
    """
    value = required(F.col("value"), F.col("status"), F.col("metric")) if strict else F.when(F.col("status") == "measured", F.col("value"))
    rows = measurements.where(F.col("metric").isin(*CORE)).select("trajectory_id", "step", "metric", value.alias("value"))
    own = Window.partitionBy("trajectory_id", "metric").orderBy("step")
    return rows.select("trajectory_id", "step", "metric", (F.col("value") - F.lag("value").over(own)).alias("delta"), F.row_number().over(own).alias("__n")).where("__n > 1").drop("__n")


def participation_ratio(vectors: DataFrame, group: str, state: str = "state") -> DataFrame:
    """(sum of eigenvalues)^2 / sum of squares of a group's covariance, from its trace and its squared entries.

    Sums of products are made by matrix products of an Arrow batch's vectors, and combined before the shuffle, so a
    group of any size is d * d numbers a batch.
    """
    schema = f"g {vectors.schema[group].dataType.simpleString()}, n long, i int, j int, s double, xy double"

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, own in frame.groupby("g", dropna=False):
                x = np.stack(own["x"].to_numpy()).astype(float)
                i, j = np.triu_indices(x.shape[1])
                yield pd.DataFrame({"g": key, "n": len(x), "i": i, "j": j, "s": np.where(i == j, x.sum(0)[i], 0.0), "xy": (x.T @ x)[i, j]})

    cells = vectors.select(F.col(group).alias("g"), F.col(state).alias("x")).mapInPandas(products, schema)
    summed = cells.groupBy("g", "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("xy").alias("xy"))
    means = summed.where("i = j").select("g", F.col("i").alias("k"), F.col("s").alias("sk"))
    a, b = means.select("g", F.col("k").alias("i"), F.col("sk").alias("si")), means.select("g", F.col("k").alias("j"), F.col("sk").alias("sj"))
    cov = summed.where("n > 1").join(a, ["g", "i"]).join(b, ["g", "j"]).select("g", "i", "j", ((F.col("xy") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("c"))
    squares = F.sum(F.when(F.col("i") == F.col("j"), F.col("c") ** 2).otherwise(2 * F.col("c") ** 2))
    return cov.groupBy(F.col("g").alias(group)).agg((F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))) ** 2 / F.nullif(squares, F.lit(0.0))).alias("participation_ratio"))


def intrinsic_dimension(vectors: DataFrame, k: int = 10, group: str = "group", near: DataFrame | None = None) -> DataFrame:
    """Mean over a group's points of the maximum-likelihood estimate from k neighbours; `near`: these or more, where known."""
    near = neighbours(vectors, k, group) if near is None else near.where(F.col("rank") <= k)
    last = F.max(F.when(F.col("rank") == k, F.col("d")))
    logs = F.sum(F.when((F.col("rank") < k) & (F.col("d") > 0), F.log("d")))
    used = F.count_if((F.col("rank") < k) & (F.col("d") > 0))
    point = near.groupBy(group, "id").agg((used / F.nullif(used * F.log(last) - logs, F.lit(0.0))).alias("lid"))
    return point.groupBy(group).agg(F.avg("lid").alias("local_intrinsic_dim"))


def connected_parts(vectors: DataFrame, k: int = 5, group: str = "group", near: DataFrame | None = None) -> DataFrame:
    """Connected parts of each group's graph of k nearest neighbours, links taken both ways: group, connected_components.
    `near`: these neighbours or more, where known.

    Round by round each point becomes that one of its neighbours and itself whose hash is least. That keeps connected what
    was and nothing else, and leaves a share of the points and links, in the order of a new hash each time; so ids in the
    order of a walk cost no more rounds than others. It ends when no point has a link.
    """
    near = neighbours(vectors, k, group) if near is None else near.where(F.col("rank") <= k)
    points = vectors.select(F.col(group).alias("g"), "id").where("g IS NOT NULL").groupBy("g").agg(F.count_distinct("id").alias("n"))
    own = near.select(F.col(group).alias("g"), F.col("id").cast("long").alias("a"), F.col("other").cast("long").alias("b"))
    links, gone, turn = cut(own.union(own.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()), points, 0
    while not links.isEmpty():
        around, self_ = (F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("c")) for c in ("b", "a"))
        least = links.groupBy("g", "a").agg(F.min(around).alias("m"))
        become = cut(least.select("g", "a", F.least("m", self_)["c"].alias("m")))
        gone = gone.union(become.groupBy("g").agg((F.count_distinct("m") - F.count(F.lit(1))).alias("n")))
        ends = links.join(become, ["g", "a"]).select("g", F.col("m").alias("c"), F.col("b").alias("a")).join(become, ["g", "a"])
        links, turn = cut(ends.where("c <> m").select("g", F.col("c").alias("a"), F.col("m").alias("b")).distinct()), turn + 1
    # As many parts as points, less those that became another.
    return gone.groupBy(F.col("g").alias(group)).agg(F.sum("n").alias("connected_components"))


def anisotropy(vectors: DataFrame, group: str, state: str = "state") -> DataFrame:
    """Length of the mean of a group's unit vectors, squared: the mean cosine over all pairs with themselves."""
    size = F.sqrt(total(F.transform(state, lambda x: x.cast("double") * x.cast("double"))))
    unit = vectors.select(group, F.posexplode(F.when(size > 0, F.transform(state, lambda x: x.cast("double") / size))).alias("i", "x"))
    return unit.groupBy(group, "i").agg(F.avg("x").alias("m")).groupBy(group).agg(F.sum(F.col("m") ** 2).alias("anisotropy"))


def pca(vectors: DataFrame, k: int, state: str = "state") -> DataFrame:
    """vectors with `projected`, their k principal coordinates about the mean."""
    rows = vectors.withColumn("__v", array_to_vector(F.transform(state, lambda x: x.cast("double"))))
    fitted = PCA(k=k, inputCol="__v", outputCol="__p").fit(rows)
    mean = rows.select(F.posexplode(state).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    shift = fitted.pc.toArray().T @ [r["m"] for r in mean]
    out = fitted.transform(rows).withColumn("projected", F.zip_with(vector_to_array("__p"), F.array(*(F.lit(float(s)) for s in shift)), lambda p, s: p - s))
    return out.drop("__v", "__p")


def preserved(before: DataFrame, after: DataFrame, k: int, group: str = "group") -> DataFrame:
    """Trustworthiness of neighbourhoods in `after` and continuity of those in `before`, by group."""
    sizes = before.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    links = {side: cut(neighbours(rows, k, group).select(F.col(group).alias("g"), "id", "other")) for side, rows in (("before", before), ("after", after))}

    def score(full: DataFrame, own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        # Neighbours in one space that are none in the other: k a point at most. Their ranks there are counts of closer points.
        off = own.join(other, ["g", "id", "other"], "left_anti")
        points = full.select(F.col(group).alias("g"), F.col("id").cast("long").alias("id"), F.transform("state", lambda x: x.cast("double")).alias("v")).where("g IS NOT NULL AND id IS NOT NULL AND v IS NOT NULL")
        blocks = Blocks(points, k)
        ranks = blocks.closer(off)
        blocks.drop()
        lost = off.groupBy("g").agg(F.count(F.lit(1)).alias("pairs")).join(ranks, "g").select(F.col("g").alias(group), (F.col("closer") + F.col("pairs") * (1 - k)).alias("lost"))
        scaled = sizes.join(lost, group, "left")
        return scaled.select(group, (1 - 2.0 / (F.col("n") * k * (2 * F.col("n") - 3 * k - 1)) * F.coalesce("lost", F.lit(0))).alias(name))

    return score(before, links["after"], links["before"], "trustworthiness").join(score(after, links["before"], links["after"], "continuity"), group)


def looked(metric: Callable | None, params: dict | None = None) -> int:
    """How many nearest neighbours a metric looks at that can take them as `near`; 0 of others."""
    run, own = (metric.func, metric.keywords) if isinstance(metric, partial) else (metric, {})
    if not getattr(run, "takes_near", False):
        return 0
    return (own | (params or {})).get("k", inspect.signature(run).parameters["k"].default)


def shared_neighbours(vectors: DataFrame, metrics: Sequence[Callable | None], params: Sequence[dict] | None = None) -> DataFrame | None:
    """The nearest neighbours of (id, state) as one group, as many as the metric that looks at most of them needs; None if
    fewer than two metrics look at any, or if there is no finding them, which then is each metric's own failure."""
    most = [k for k in map(looked, metrics, params or [{}] * len(metrics)) if k]
    if len(most) < 2:
        return None
    try:
        one = vectors.select(F.lit(0).alias("group"), F.col("id").cast("long").alias("id"), F.col("state").cast("array<double>").alias("state"))
        return neighbours(one, max(most))
    except Exception:  # noqa: BLE001 - a metric that needs them fails by itself
        return None


def measure(vectors: DataFrame, metrics: dict[str, Callable[[DataFrame], DataFrame] | None], requested: Sequence[str]) -> list[tuple]:
    """(metric, status, value, reason) of each metric on one set of vectors.

    A metric is a plan of one row with a column as `number` takes it. One that fails, in planning or in running, is
    failed with its error, and the others stand.
    """
    out, shared = [], shared_neighbours(vectors, [m for name, m in metrics.items() if name in requested])
    for name, metric in metrics.items():
        if name not in requested:
            out.append((name, "not_requested", None, None))
            continue
        try:
            answer = metric(vectors, near=shared) if shared is not None and looked(metric) else metric(vectors)
            row = answer.select(number(answer).alias("v")).first()
            value = None if row is None else row["v"]
            if value is None or not math.isfinite(value):
                out.append((name, "failed", None, NON_FINITE))
            else:
                out.append((name, "measured", float(int(value)) if name in WHOLE else value, None))
        except Exception as error:  # noqa: BLE001 - any metric may fail, and its failure is the measurement
            out.append((name, "failed", None, f"{type(error).__name__}: {error}"[:500]))
    return out


def trajectory(raw: DataFrame, transforms: Sequence[Callable[[DataFrame], DataFrame]], metrics: dict[str, Callable[[DataFrame], DataFrame] | None], requested: Sequence[str], folder: str | None = None) -> DataFrame:
    """Measurements of the raw vectors and after each transform: step, metric, status, value, reason, seconds.

    Each step's vectors are written once, as step=k of the folder or else as a checkpoint, and all metrics read them.
    """
    spark, rows, now = raw.sparkSession, [], raw
    for step, change in enumerate([None, *transforms]):
        began = time.perf_counter()
        now = change(now) if change else now
        if folder:
            now.write.mode("overwrite").parquet(f"{folder}/step={step}")
            now = spark.read.parquet(f"{folder}/step={step}")
        else:
            now = cut(now)
        took = time.perf_counter() - began if change else 0.0
        rows += [(step, *m, took) for m in measure(now, metrics, requested)]
    return spark.createDataFrame(rows, "step int, metric string, status string, value double, reason string, seconds double")


def timings(times: DataFrame, key: str, seconds: str = "seconds") -> DataFrame:
    """key, n, mean, std (of the whole, not of a sample), low and high of the times."""
    t = F.col(seconds)
    return times.groupBy(key).agg(F.count(t).alias("n"), F.avg(t).alias("mean"), F.stddev_pop(t).alias("std"), F.min(t).alias("low"), F.max(t).alias("high"))
