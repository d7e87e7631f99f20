"""Diffusion over the graph of nearest neighbours, and PHATE's picture of it.

PHATE (Moon et al. 2019, Nature Biotechnology 37) takes an alpha-decaying kernel with a bandwidth of its own for each
point, the distance to its k-th neighbour, makes it a Markov matrix P, lets that run for t steps, takes the logarithm of
the transition probabilities as a potential, and scales the distances between potentials by metric MDS.

  K(x, y) = 1/2 exp(-(|x - y| / e(x))^alpha) + 1/2 exp(-(|x - y| / e(y))^alpha)

A term is kept where y is among the nearest of x (or x of y) that are looked at, and where it isn't below LEAST, so the
kernel has a few entries a point. Of a group with more points than landmarks, points are dealt out to the nearest of as
many pivots; the walk from landmark to landmark goes through all points between, which is one sparse product,

  P(c, c') = sum over x of P(c, x) P(x, c'),   P(c, x) in proportion to the kernel from the points of c to x,

and runs t steps there; points take their place from the landmarks that they step to (section "Scalable PHATE"). So a
task holds the square of a number of landmarks, which is a parameter, and never a group. Where a group has no more
points than that, each is its own landmark and P itself runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import neighbours as nb
from lumenfold.session import clean_cut as cut
from lumenfold.session import ship

#: Kernel values below this are 0; added to probabilities before the logarithm; landmarks of a group.
LEAST, FLOOR, LANDMARKS = 1e-4, 1e-7, 500
#: Rounds of stress majorisation, and the share of the stress that one must take off for there to be another.
ROUNDS, GAIN = 300, 1e-6
#: Rows of a product that a task makes, about, and products of two entries that it has at once.
ROWS, PAIRS = 8192, 2_000_000


def decaying(near: DataFrame, k: int, alpha: float, group: str = "group") -> DataFrame:
    """(group, id, other, d, rank) of at least k neighbours -> group, a, b, w: the kernel, both ways and with itself.

    A point with k copies of itself has no bandwidth, and a kernel of 1 with its copies and 0 with others.
    """
    width = near.where(F.col("rank") == k).select(group, "id", F.col("d").alias("e"))
    w = F.when(F.col("d") == 0, 1.0).when(F.col("e") > 0, F.exp(-F.pow(F.col("d") / F.nullif(F.col("e"), F.lit(0.0)), alpha))).otherwise(0.0)
    # A point of a group with fewer neighbours has the farthest as its bandwidth.
    last = near.groupBy(group, "id").agg(F.max("d").alias("far"))
    sized = near.join(last, [group, "id"]).join(width, [group, "id"], "left").withColumn("e", F.coalesce("e", "far"))
    one = sized.select(group, F.col("id").alias("a"), F.col("other").alias("b"), w.alias("w")).where(F.col("w") >= LEAST)
    both = one.union(one.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy(group, "a", "b").agg((F.sum("w") / 2).alias("w"))


def with_selves(kernel: DataFrame, points: DataFrame, group: str = "group") -> DataFrame:
    """The kernel with 1 for each point and itself."""
    return kernel.union(points.select(group, F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("w")))


def markov(kernel: DataFrame, group: str = "group") -> DataFrame:
    """group, a, b, w -> p: w by the sum of a's."""
    total = kernel.groupBy(group, "a").agg(F.sum("w").alias("total"))
    return kernel.join(total, [group, "a"]).select(group, "a", "b", (F.col("w") / F.col("total")).alias("p"))


def product(left: DataFrame, right: DataFrame, group: str = "group", block: int = ROWS) -> DataFrame:
    """The product of two sparse matrices (group, a, b, p), by group.

    A task makes a block of the result's rows: it gets these rows of the left matrix and of the right one each row that
    they need, once a block and not once for each step that leads through it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    sizes = left.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count_distinct("a").alias("n"))
    own = left.withColumnRenamed(group, "g").join(sizes, "g").select("g", "a", F.col("b").alias("x"), "p", F.pmod(F.xxhash64("a"), F.greatest(F.lit(1), F.ceil(F.col("n") / block))).alias("block"))
    lists = right.select(F.col(group).alias("g"), F.col("a").alias("x"), F.struct("b", "p").alias("s")).groupBy("g", "x").agg(F.collect_list("s").alias("l"))
    lists = lists.select("g", "x", F.col("l.b").alias("bs"), F.col("l.p").alias("ps"))
    needed = own.select("g", "block", "x").distinct().join(lists, ["g", "x"]).select(F.col("g").alias("h"), F.col("block").alias("part"), F.col("x").alias("at"), "bs", "ps")

    def multiply(rows: pd.DataFrame, columns: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
        if not len(rows) or not len(columns):
            return
        rows, place = rows.sort_values("a", kind="stable"), pd.Index(columns["at"])
        n = columns["bs"].map(len).to_numpy()
        begin, bs, ps = np.cumsum(n) - n, np.concatenate(columns["bs"].to_numpy()), np.concatenate(columns["ps"].to_numpy())
        at = place.get_indexer(rows["x"])
        rows, at = rows[at >= 0], at[at >= 0]
        a, p, many = rows["a"].to_numpy(), rows["p"].to_numpy(), n[at]
        ends = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a))
        start = 0
        while start < len(a):  # whole rows of the result, some PAIRS products at once
            over = np.searchsorted(np.cumsum(many[start:])[ends[ends > start] - 1 - start], PAIRS, "right")
            stop = ends[ends > start][max(0, over - 1)]
            m = many[start:stop]
            entry = np.repeat(begin[at[start:stop]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            to, w, of = bs[entry], ps[entry] * np.repeat(p[start:stop], m), np.repeat(a[start:stop], m)
            order = np.lexsort((to, of))
            to, of, w = to[order], of[order], w[order]
            first = np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (of[1:] != of[:-1]))) if len(to) else np.zeros(0, int)
            if len(first):
                yield of[first], to[first], np.add.reduceat(w, first)
            start = stop

    def multiplied(rows: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
        found = list(multiply(rows, columns))
        a, b, p = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (int, int, float))
        return pd.DataFrame({"g": pd.Series([rows["g"].iloc[0]] * len(a), dtype=object if kinds[group] == "string" else None), "a": a, "b": b, "p": p})

    both = own.groupBy("g", "block").cogroup(needed.groupBy("h", "part"))
    return both.applyInPandas(multiplied, f"g {kinds[group]}, a {kinds['a']}, b {dict(right.dtypes)['b']}, p double").withColumnRenamed("g", group)


def landmarks(points: DataFrame, most: int, group: str = "group", state: str = "state") -> DataFrame:
    """group, id, mark: the number of the landmark of each point, the nearest of at most `most` pivots of its group."""
    ship(points.sparkSession)
    kind = points.schema[group].dataType
    ddl = f"g {kind.simpleString()}, cell string, above long, ids array<long>, x binary"
    schema = nb._arrow(kind, cell=pa.string(), above=pa.int64(), ids=nb.IDS, x=pa.binary())
    rows = nb.packed(points.select(F.col(group).alias("g"), "id", F.col(state).cast("array<double>").alias("v"))).select("g", F.lit("root").alias("cell"), F.lit(None).cast("long").alias("above"), F.array("id").alias("ids"), "x")
    packed = cut(rows.sortWithinPartitions("g").mapInArrow(nb._merged(schema, nb.BLOCK), ddl))
    offers = packed.mapInArrow(nb._offered(nb._arrow(kind, cell=pa.string(), h=pa.int64(), x=nb.XS), most, 0), f"g {kind.simpleString()}, cell string, h long, x array<double>")
    chosen = offers.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("rank") <= most)
    pivots = chosen.groupBy("g").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("h", "x"))), lambda p: p["x"])).alias("pivots"))
    dealt = packed.join(pivots, "g").select("g", "cell", "ids", "x", "pivots", F.lit(0).cast("long").alias("n")).mapInArrow(nb._dealt(schema), ddl)
    return dealt.select(F.col("g").alias(group), F.explode("ids").alias("id"), F.substring_index("cell", "/", -1).cast("long").alias("mark"))


def scaled(distances: np.ndarray, dims: int) -> np.ndarray:
    """Metric MDS by majorisation from the classical solution; each axis has its largest coordinate positive."""
    n = len(distances)
    centred = -0.5 * (distances**2 - (distances**2).mean(0) - (distances**2).mean(1)[:, None] + (distances**2).mean())
    values, axes = np.linalg.eigh((centred + centred.T) / 2)
    values, axes = values[::-1][:dims], axes[:, ::-1][:, :dims]
    y = axes * np.sqrt(np.maximum(values, 0))
    y = np.pad(y, ((0, 0), (0, dims - y.shape[1])))
    before = np.inf
    for _ in range(ROUNDS):
        d = np.sqrt(np.maximum(((y[:, None] - y[None]) ** 2).sum(-1), 0))
        stress = ((distances - d) ** 2).sum()
        if not stress < before * (1 - GAIN):
            break
        before = stress
        ratio = np.divide(distances, d, out=np.zeros_like(d), where=d > 0)
        y = (ratio.sum(1)[:, None] * y - ratio @ y) / n
    y = y - y.mean(0)
    largest = y[np.abs(y).argmax(0), np.arange(dims)]
    return y * np.where(largest < 0, -1, 1)


def potential(p: np.ndarray, t: int) -> np.ndarray:
    """Distances between the logarithms of a Markov matrix's rows after t steps."""
    u = -np.log(np.linalg.matrix_power(p, t) + FLOOR)
    squares = (u**2).sum(1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * (u @ u.T), 0) * (1 - np.eye(len(u))))


def phate(vectors: DataFrame, k: int = 5, alpha: float = 40.0, t: int = 10, dims: int = 2, most: int = LANDMARKS, looked: int | None = None, group: str = "group", state: str = "state") -> DataFrame:
    """(group, id, state) -> group, id, projected. `looked`: neighbours of a point that may have a kernel, 3 k if None.

    Rows without group, id or state take no part; ids are whole numbers, one a row. A group of one point lies at 0.
    """
    points = cut(vectors.select(F.col(group).alias("group"), F.col("id").cast("long").alias("id"), F.transform(state, lambda x: x.cast("double")).alias("state")).where("group IS NOT NULL AND id IS NOT NULL AND state IS NOT NULL"))
    kernel = cut(with_selves(decaying(nb.neighbours(points, looked or 3 * k), k, alpha), points))
    sizes = cut(points.groupBy("group").agg(F.count(F.lit(1)).alias("n")))
    large = sizes.where(F.col("n") > most).select("group")
    own = points.join(large, "group", "left_anti")
    # A point's own mark is its place among its group's ids, of which there are no more than landmarks.
    alone = own.select("group", "id", (F.row_number().over(Window.partitionBy("group").orderBy("id")) - 1).cast("long").alias("mark"))
    marks = cut(alone.union(landmarks(points.join(large, "group", "left_semi"), most)))
    step = cut(markov(kernel))
    goal = marks.select("group", F.col("id").alias("b"), F.col("mark").alias("m"))
    to = cut(step.join(goal, ["group", "b"]).groupBy("group", "a", F.col("m").alias("b")).agg(F.sum("p").alias("p")))
    start = marks.select("group", F.col("id").alias("a"), F.col("mark").alias("m"))
    out = markov(kernel.join(start, ["group", "a"]).groupBy("group", F.col("m").alias("a"), "b").agg(F.sum("w").alias("w")))
    few = out.join(large, "group", "left_semi")
    between = product(few, to).union(to.join(large, "group", "left_anti").join(start, ["group", "a"]).select("group", F.col("m").alias("a"), "b", "p"))
    kind = points.schema["group"].dataType.simpleString()

    def placed(cells: pd.DataFrame) -> pd.DataFrame:
        """Of one group: at most `most` landmarks' matrix."""
        n = int(max(cells["a"].max(), cells["b"].max())) + 1
        p = np.zeros((n, n))
        p[cells["a"], cells["b"]] = cells["p"]
        used = np.flatnonzero(p.sum(1))
        y = scaled(potential(p[np.ix_(used, used)], t), dims) if len(used) > 1 else np.zeros((1, dims))
        return pd.DataFrame({"g": cells["g"].iloc[0], "b": used, "y": list(y)})

    at = between.withColumnRenamed("group", "g").groupBy("g").applyInPandas(placed, f"g {kind}, b long, y array<double>").withColumnRenamed("g", "group")
    at = cut(at)
    # Points of small groups are landmarks; others lie between those that they step to.
    whole = alone.join(at.withColumnRenamed("b", "mark"), ["group", "mark"]).select("group", "id", "y")
    cells = to.join(large, "group", "left_semi").join(at, ["group", "b"]).select("group", F.col("a").alias("id"), "p", F.posexplode("y").alias("i", "v"))
    mixed = cells.groupBy("group", "id", "i").agg(F.sum(F.col("p") * F.col("v")).alias("v")).groupBy("group", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("y"))
    return whole.union(mixed).select(F.col("group").alias(group), F.col("id").cast(vectors.schema["id"].dataType).alias("id"), F.col("y").alias("projected"))
