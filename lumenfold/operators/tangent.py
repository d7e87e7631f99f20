"""Tangent spaces of a point cloud, by principal components of each neighbourhood, and the angles between them.

The tangent space at a point is spanned by the leading right singular vectors of its k nearest neighbours about their
mean (local principal component analysis, as in tangent space alignment, Zhang and Zha 2004). Its dimension is the
number of components that hold a share of the neighbourhood's variance. Two spaces are compared by their principal
angles, whose cosines are the singular values of the product of their bases (Björck and Golub 1973).

A neighbourhood is k vectors, so a task holds a batch of those and nothing of the rest of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.neighbours import neighbours
from lumenfold.session import cut, ship


def local_bases(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbourhoods (n, k, d) -> bases (n, m, d) and variances (n, min(k, d)), largest first."""
    _, s, v = np.linalg.svd(x - x.mean(1, keepdims=True), full_matrices=False)
    return v[:, :m], s**2


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Principal angles (n, m), smallest first, between bases (n, m, d); small ones from sines, which keep their digits."""
    cosine = np.clip(np.linalg.svd(a @ b.transpose(0, 2, 1), compute_uv=False), 0, 1)
    off = b - (b @ a.transpose(0, 2, 1)) @ a
    sine = np.clip(np.linalg.svd(off, compute_uv=False)[:, ::-1], 0, 1)
    return np.where(cosine**2 < 0.5, np.arccos(cosine), np.arcsin(sine[:, : cosine.shape[1]]))


def tangent_spaces(vectors: DataFrame, k: int = 10, m: int = 2, variance: float = 0.95, group: str = "group", state: str = "state", near: DataFrame | None = None) -> DataFrame:
    """(group, id, state) -> group, id, dimension, basis (m directions, one after the other).

    Points with fewer than k neighbours have no tangent space. A neighbourhood without extent has dimension 0.
    """
    ship(vectors.sparkSession)
    near = neighbours(vectors, k, group, state) if near is None else near
    others = vectors.select(group, F.col("id").alias("other"), F.transform(state, lambda x: x.cast("double")).alias("x"))
    lists = near.join(others, [group, "other"]).groupBy(group, "id").agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("l")).where(F.size("l") == k)
    lists = lists.select(F.col(group).alias("g"), "id", F.flatten(F.transform("l", lambda p: p["x"])).alias("x"))
    schema = f"g {vectors.schema[group].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, dimension int, basis array<double>"

    def bases(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, own in frame.groupby(frame["x"].map(len)):
                x = np.stack(own["x"].to_numpy()).reshape(len(own), k, -1)
                basis, spread = local_bases(x, m)
                total = spread.sum(1, keepdims=True)
                held = np.cumsum(spread, 1) >= variance * total * (1 - 1e-12)
                yield pd.DataFrame({"g": own["g"], "id": own["id"], "dimension": np.where(total[:, 0] > 0, held.argmax(1) + 1, 0).astype(np.int32), "basis": list(basis.reshape(len(own), -1))})

    return lists.mapInPandas(bases, schema).withColumnRenamed("g", group)


def tangent_space(vectors: DataFrame, k: int = 10, m: int = 2, variance: float = 0.95, group: str = "group", state: str = "state") -> DataFrame:
    """By group: n points with a tangent space, their mean dimension, and the mean over links of neighbours of the largest
    principal angle between the spaces of m directions at both ends, in radians."""
    near = cut(neighbours(vectors, k, group, state))
    spaces = cut(tangent_spaces(vectors, k, m, variance, group, state, near))
    here, there = spaces.select(group, "id", F.col("basis").alias("a")), spaces.select(group, F.col("id").alias("other"), F.col("basis").alias("b"))
    schema = f"g {vectors.schema[group].dataType.simpleString()}, n long, angle double"

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (g, _), own in frame.groupby([frame["g"], frame["a"].map(len)], dropna=False):
                a, b = (np.stack(own[c].to_numpy()).reshape(len(own), -1, max(1, len(own["a"].iloc[0]) // m)) for c in ("a", "b"))
                yield pd.DataFrame({"g": [g], "n": [len(own)], "angle": [angles(a, b)[:, -1].sum()]})

    links = near.select(group, "id", "other").join(here, [group, "id"]).join(there, [group, "other"]).select(F.col(group).alias("g"), "a", "b")
    summed = links.mapInPandas(compared, schema).groupBy("g").agg((F.sum("angle") / F.sum("n")).alias("angle"))
    means = spaces.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("dimension").alias("dimension"))
    return means.join(summed.withColumnRenamed("g", group), group, "left").select(group, "n", "dimension", "angle")
