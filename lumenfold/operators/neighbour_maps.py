"""t-SNE: affinities by perplexity over the graph of nearest neighbours, and a layout whose repulsion comes from a tree.

Affinities are those of van der Maaten and Hinton (2008), over the 3 * perplexity nearest as in van der Maaten (2014):
p(y | x) falls with the squared distance by a precision of x's own, which bisection sets so that the entropy is the
perplexity's logarithm; p(x, y) is the mean of both directions by the number of points.

The gradient of x is 4 sum over y of (p(x, y) f - q(x, y)) q0 (x - y), q0 = 1 / (1 + |x - y|^2), q = q0 / Z. Its first part
runs over links, by joins. The second comes from a quadtree over the plane, as Barnes and Hut have it: a cell stands for
its points where it looks small enough from x, its side less than THETA of its distance, and its deepest cells do so in
any case. A round's tree is the counts and centres of at most 4 ** DEPTH cells, which is what the driver and each task
hold, whatever the number of points. Z is the sum of what all points get from the tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.neighbours import listed, neighbour_lists
from lumenfold.session import clean_cut as cut
from lumenfold.session import ship

#: Halvings of the bisection; depth of the tree; how large a cell may look that stands for its points.
HALVINGS, DEPTH, THETA = 60, 8, 0.5
#: Steps with exaggerated attraction, by how much, momentum then and later.
EARLY, MORE, SLOW, FAST = 0.25, 12.0, 0.5, 0.8


def conditional(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Distances (n, k) -> rows of probabilities whose entropy is log(perplexity), or of equal ones where k is too small."""
    squares = d**2 - (d**2).min(1, keepdims=True)
    goal = math.log(min(perplexity, d.shape[1]))
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)) / np.maximum(squares.mean(1), 1e-300)
    for _ in range(HALVINGS):
        w = np.exp(-squares * beta[:, None])
        total = w.sum(1)
        entropy = np.log(total) + beta * (squares * w).sum(1) / total
        wide = entropy > goal
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isfinite(high), (low + high) / 2, 2 * beta)
        beta = np.minimum(beta, 1e300)
    w = np.exp(-squares * beta[:, None])
    return w / w.sum(1, keepdims=True)


def affinities(near: DataFrame, perplexity: float) -> DataFrame:
    """(id, other, d, rank) or (id, others, d) of one graph -> a, b, p, each link both ways; all of them sum up to 1."""
    ship(near.sparkSession)
    rows = near.select("id", "others", "d") if "others" in near.columns else cut(listed(near, "id"))

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, own in frame.groupby(frame["d"].map(len)):
                yield pd.DataFrame({"a": own["id"].repeat(k), "b": np.concatenate(own["others"].to_numpy()), "p": conditional(np.stack(own["d"].to_numpy()), perplexity).ravel()})

    one = rows.mapInPandas(weigh, "a long, b long, p double")
    n = rows.count()
    both = one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "p"))
    return both.groupBy("a", "b").agg((F.sum("p") / (2.0 * max(n, 1))).alias("p"))


class Tree:
    """A quadtree from its deepest cells' counts and sums of coordinates."""

    def __init__(self, low: np.ndarray, side: float, cells: np.ndarray, depth: int):
        """cells: rows (i, j, n, sum of x, sum of y)."""
        self.low, self.side, self.levels = low, side, []
        grid = np.zeros((1 << depth, 1 << depth, 3))
        if len(cells):
            grid[cells[:, 0].astype(int), cells[:, 1].astype(int)] = cells[:, 2:]
        while True:
            self.levels.append(grid)
            if len(grid) == 1:
                break
            grid = grid.reshape(len(grid) // 2, 2, len(grid) // 2, 2, 3).sum((1, 3))
        self.levels.reverse()

    def repulsion(self, y: np.ndarray, theta: float = THETA) -> tuple[np.ndarray, np.ndarray]:
        """(sum of q0^2 (y - c), sum of q0) of each of y over all points of the tree but itself."""
        force, z = np.zeros_like(y), np.zeros(len(y))
        point, i, j = np.arange(len(y)), np.zeros(len(y), int), np.zeros(len(y), int)
        for level, grid in enumerate(self.levels):
            n, centre = grid[i, j, 0].copy(), grid[i, j, 1:].copy()
            side, deepest = self.side / (1 << level), level + 1 == len(self.levels)
            at = np.minimum(((y[point] - self.low) / side).astype(int), (1 << level) - 1)
            own = (at[:, 0] == i) & (at[:, 1] == j)
            if deepest:  # a point's own cell stands for the others in it
                n[own] -= 1
                centre[own] -= y[point[own]]
            live = n > 0
            c = centre / np.maximum(n, 1)[:, None]
            gap = y[point] - c
            d2 = (gap**2).sum(1)
            told = live & ((side**2 < theta**2 * d2) & ~own | deepest)
            q = 1 / (1 + d2[told])
            np.add.at(z, point[told], n[told] * q)
            np.add.at(force, point[told], (n[told] * q * q)[:, None] * gap[told])
            down = live & ~told
            point, i, j = (np.repeat(x[down], 4) for x in (point, i, j))
            i, j = 2 * i + np.tile([0, 0, 1, 1], down.sum()), 2 * j + np.tile([0, 1, 0, 1], down.sum())
        return force, z


def tree(points: DataFrame, depth: int = DEPTH) -> Tree:
    """Of (x, y): at most 4 ** depth rows come to the driver."""
    r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    low, side = np.array(r[:2], float), max(r[2] - r[0], r[3] - r[1], 1e-12) * (1 + 1e-9)
    place = lambda c, k: F.least(F.floor((F.col(c) - float(low[k])) * ((1 << depth) / side)), F.lit((1 << depth) - 1))
    cells = points.groupBy(place("x", 0).alias("i"), place("y", 1).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).collect()
    return Tree(low, side, np.array([tuple(c) for c in cells], float).reshape(-1, 5), depth)


def gradient(links: DataFrame, points: DataFrame, more: float = 1.0, depth: int = DEPTH) -> DataFrame:
    """links (a, b, p), points (id, x, y) -> id, gx, gy."""
    whole = tree(points, depth)

    def push(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            force, z = whole.repulsion(frame[["x", "y"]].to_numpy())
            yield frame[["id", "x", "y"]].assign(fx=force[:, 0], fy=force[:, 1], z=z)

    pushed = cut(points.select("id", "x", "y").mapInPandas(push, "id long, x double, y double, fx double, fy double, z double"))
    z = pushed.agg(F.sum("z")).first()[0] or 1.0
    here, there = points.select(F.col("id").alias("a"), "x", "y"), points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    gap = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    near = F.col("p") / (1 + gap[0] * gap[0] + gap[1] * gap[1])
    pulled = links.join(here, "a").join(there, "b").groupBy(F.col("a").alias("id")).agg(F.sum(near * gap[0]).alias("ax"), F.sum(near * gap[1]).alias("ay"))
    both = pushed.join(pulled, "id", "left")
    of = lambda a, f: 4 * (more * F.coalesce(F.col(a), F.lit(0.0)) - F.col(f) / z)
    return both.select("id", of("ax", "fx").alias("gx"), of("ay", "fy").alias("gy"))


def tsne(vectors: DataFrame, perplexity: float = 30.0, steps: int = 60, rate: float | None = None, state: str = "state") -> DataFrame:
    """(id, state) -> id, projected: all vectors as one graph, from small principal components on, a step a round."""
    from lumenfold.operators.geometry import pca

    points = cut(vectors.select(F.lit(0).alias("group"), F.col("id").cast("long").alias("id"), F.transform(state, lambda x: x.cast("double")).alias("state")).where("id IS NOT NULL AND state IS NOT NULL"))
    n = points.count()
    if n < 3:
        return points.select("id", F.array(F.col("id") * 0.0, F.col("id") * 0.0).alias("projected"))
    links = cut(affinities(neighbour_lists(points, max(2, int(3 * perplexity))), perplexity))
    flat = pca(points, 2).select("id", F.get("projected", F.lit(0)).alias("x"), F.get("projected", F.lit(1)).alias("y"))
    spread = flat.agg(F.stddev_pop("x")).first()[0] or 1.0
    now = cut(flat.select("id", (F.col("x") * (1e-2 / spread)).alias("x"), (F.col("y") * (1e-2 / spread)).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy")))
    early = int(EARLY * steps)
    for step in range(steps):
        more, keep = (MORE, SLOW) if step < early else (1.0, FAST)
        speed = rate or max(n / MORE / 4, 50.0)
        moved = now.join(gradient(links, now, more), "id")
        v = lambda c: keep * F.col(f"v{c}") - speed * F.col(f"g{c}")  # noqa: B023, E731 - used at once
        now = cut(moved.select("id", (F.col("x") + v("x")).alias("x"), (F.col("y") + v("y")).alias("y"), v("x").alias("vx"), v("y").alias("vy")))
    return now.select("id", F.array("x", "y").alias("projected"))
