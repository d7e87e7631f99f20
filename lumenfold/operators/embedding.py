"""UMAP over the graph of nearest neighbours: fuzzy links exactly, and a layout in rounds over blocks of points.

The graph is that of McInnes, Healy and Melville (2018, section 3.1). The link from x to one of its k nearest y weighs
exp(-max(0, |x - y| - rho) / sigma), rho the distance to the nearest at all, and sigma such that the weights of x sum up
to log2(k); bisection finds it. The union of both directions is a + b - ab.

The layout follows section 3.2: linked points attract with the gradient of log 1 / (1 + a d^2b), others repel, and moves
are clipped and shrink as rounds go on. A link is used as often as its weight says. Links are dealt out by their first
point, points by a hash into blocks of bounded size, and in a round each block moves its own points some epochs, the ends
that lie in other blocks staying where the last round left them. A round's positions are checkpointed. What repels a
point is a draw from all points, which is one bounded sample a round, so no task holds more than its block, its links
and that sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.neighbours import listed, neighbour_lists
from lumenfold.session import Stored, ship
from lumenfold.session import clean_cut as cut

#: Bisection ends after so many halvings, or this close to the goal; the least share of the mean distance for sigma.
HALVINGS, CLOSE, LEAST_SIGMA = 64, 1e-5, 1e-3
#: Points of a block; points that repel a round; those that a step takes of them; the largest move along an axis.
BLOCK, SAMPLE, DRAWN, CLIP = 4096, 2048, 5, 4.0
#: Blocks of a wave for each core.
TURNS = 4


def smoothed(d: np.ndarray) -> np.ndarray:
    """Sorted distances (n, k) of points to their neighbours -> weights whose rows sum up to log2(k), where they can."""
    k = d.shape[1]
    goal = math.log2(k)
    rho = np.where((d > 0).any(1), np.where(d > 0, d, np.inf).min(1), 0.0)
    off = np.maximum(d - rho[:, None], 0)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    live = np.ones(len(d), bool)
    for _ in range(HALVINGS):
        total = np.exp(-off / sigma[:, None]).sum(1)
        live = np.abs(total - goal) >= CLOSE
        if not live.any():
            break
        large = live & (total > goal)
        small = live & ~large
        high[large], low[small] = sigma[large], sigma[small]
        middle = np.where(np.isfinite(high), (low + high) / 2, 2 * sigma)
        sigma = np.where(live, middle, sigma)
    floor = LEAST_SIGMA * np.where(rho > 0, d.mean(1), d.mean())
    sigma = np.maximum(sigma, np.maximum(floor, np.finfo(float).tiny))
    return np.exp(-off / sigma[:, None])


def weighed(near: DataFrame, group: str = "group") -> DataFrame:
    """(group, id, other, d, rank) or (group, id, others, d) -> g, a, b, w: how near b is to a, one of whose nearest it is."""
    ship(near.sparkSession)
    rows = (near if "others" in near.columns else listed(near, group, "id")).select(F.col(group).alias("g"), "id", "others", "d")
    kind = near.schema[group].dataType.simpleString()

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, own in frame.groupby(frame["d"].map(len)):
                w = smoothed(np.stack(own["d"].to_numpy())) if k > 1 else np.ones((len(own), 1))
                yield pd.DataFrame({"g": own["g"].repeat(k), "a": own["id"].repeat(k), "b": np.concatenate(own["others"].to_numpy()), "w": w.ravel()})

    return rows.mapInPandas(weigh, f"g {kind}, a long, b long, w double")


def united(one: DataFrame) -> DataFrame:
    """g, a, b, w of one direction -> g, a, b, w of the fuzzy union, each link both ways."""
    both = one.union(one.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    # Of the two directions' weights x and y, the sum less the product; a link that has one direction keeps its weight.
    return both.groupBy("g", "a", "b").agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.product("w")).otherwise(0.0)).alias("w"))


def fuzzy_links(near: DataFrame, group: str = "group") -> DataFrame:
    """(group, id, other, d, rank) or (group, id, others, d) -> group, a, b, w of the fuzzy union, each link both ways."""
    return united(weighed(near, group)).select(F.col("g").alias(group), "a", "b", "w")


def curve(spread: float = 1.0, least: float = 0.1) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b) that come closest to 1 up to the least distance and an exponential decay beyond it."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < least, 1.0, np.exp(-(x - least) / spread))
    a, b = 1.5, 0.9
    for _ in range(200):  # Gauss and Newton, in the logarithms, which stay positive
        power = a * x ** (2 * b)
        f = 1 / (1 + power)
        slope = -f * f * power
        j = np.stack([slope, slope * 2 * b * np.log(x)], 1)
        step = np.linalg.lstsq(j, y - f, rcond=None)[0]
        a, b = a * math.exp(np.clip(step[0], -0.5, 0.5)), b * math.exp(np.clip(step[1], -0.5, 0.5))
        if np.abs(step).max() < 1e-12:
            break
    return a, b


def _epochs(y: np.ndarray, head: np.ndarray, tail: np.ndarray, far: np.ndarray, weight: np.ndarray, sample: np.ndarray, a: float, b: float, alphas: list[float], rng: np.random.Generator) -> np.ndarray:
    """Positions of a block's points after some epochs. A link goes from its head, a place in y, to its tail, another, or
    where that is -1 to a fixed position."""
    for alpha in alphas:
        used = rng.random(len(weight)) < weight
        h = head[used]
        end = np.where((tail[used] >= 0)[:, None], y[np.maximum(tail[used], 0)], far[used])
        gap = y[h] - end
        d2 = (gap**2).sum(1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)
        move = np.zeros_like(y)
        np.add.at(move, h, np.clip(pull[:, None] * gap, -CLIP, CLIP))
        for _ in range(DRAWN):
            gap = y[h] - sample[rng.integers(0, len(sample), len(h))]
            d2 = (gap**2).sum(1)
            push = 2 * b / ((0.001 + d2) * (1 + a * d2**b))
            np.add.at(move, h, np.where((d2 > 0)[:, None], np.clip(push[:, None] * gap, -CLIP, CLIP), 0))
        y = y + alpha * move
    return y


LINKS = "block int, ids binary, counts binary, tails binary, w binary, top double, far array<int>, ends array<binary>"
PLACES = "block int, ids binary, xy binary"
SENT = "block int, sender int, ids binary, xy binary, absent binary"


def _numbers(ids: np.ndarray) -> bytes:
    """ids in four bytes each where that keeps them, or else in eight; the first byte says which."""
    short = not len(ids) or (ids.min() >= 0 and ids.max() < 1 << 32)
    return b"\4" + ids.astype("<u4").tobytes() if short else b"\x08" + ids.astype("<i8").tobytes()


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<i8", offset=1).astype(np.int64)


def _xy(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, 2)


def _place(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where in ids, which are sorted, each of the others stands, or -1."""
    if not len(ids):
        return np.full(len(of), -1)
    at = np.minimum(np.searchsorted(ids, of), len(ids) - 1)
    return np.where(ids[at] == of, at, -1)


def _by_block(make: Callable[..., dict], names: list[str], types: list[pa.DataType]):
    """Rows of a block, which follow each other and whose first column it is -> one row of what `make` has of the others."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            made = {"block": block} | make(*map(np.concatenate, zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([made[n]], t) for n, t in zip(names, types, strict=True)], names)

        block, held = None, []
        for batch in batches:
            own, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if held and own[start] != block:
                    yield row()
                    held = []
                block = int(own[start])
                held.append([c[start:end] for c in rest])
        if held:
            yield row()

    return gather


def _packed_links(far: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> dict:
    """A block's links by a and b: its points and how many links each has, weights, and of each link the place of its end
    among all ends, which are listed by their blocks (`far`) and ids."""
    ids, counts = np.unique(a, return_counts=True)
    ends, first, link = np.unique(b, return_index=True, return_inverse=True)
    order = np.lexsort((ends, far[first]))
    place = np.empty(len(order), "<u4")
    place[order] = np.arange(len(order))
    blocks, starts = np.unique(far[first][order], return_index=True)
    wanted = [_numbers(x) for x in np.split(ends[order], starts[1:])]
    known = w[~np.isnan(w)]
    return {"ids": _numbers(ids), "counts": counts.astype("<u4").tobytes(), "tails": place[link].tobytes(), "w": w.astype("<f8").tobytes(), "top": known.max() if len(known) else None, "far": blocks, "ends": wanted}


def _packed_places(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
    return {"ids": _numbers(ids), "xy": np.stack([x, y], 1).astype("<f8").tobytes()}


def _unpacked_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, xy in zip(batch.column(0), batch.column(1), strict=True):
            at = _xy(xy.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(_ids(ids.as_py())), pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())], ["id", "x", "y"])


def _sender(waves: int, wave: int):
    """A block's points and what others want of them -> positions for each of these, and the whole block for itself if it
    moves in this wave."""

    def send(key: tuple, own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        block, out = int(key[0]), []
        ids, at = (_ids(own["ids"][0]), _xy(own["xy"][0])) if len(own) else (np.zeros(0, np.int64), np.zeros((0, 2)))
        if len(own) and block % waves == wave:
            out.append((block, -1, own["ids"][0], own["xy"][0], b""))
        for to, ends in zip(wanted["to"], wanted["ends"], strict=True):
            place = _place(ids, _ids(ends))
            sent = np.zeros((len(place), 2))
            sent[place >= 0] = at[place[place >= 0]]
            out.append((to, block, None, sent.tobytes(), np.flatnonzero(place < 0).astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["block", "sender", "ids", "xy", "absent"])

    return send


def _mover(sample: np.ndarray, top: float, a: float, b: float, alphas: list[float], seed: int):
    """A block's links and what it was sent -> its points where they are after some epochs. A link to or from an id that
    has no position isn't used."""

    def moved(links: pd.Series, own: np.ndarray, y: np.ndarray, sent: dict) -> np.ndarray:
        ids, ends = _ids(links["ids"]), np.concatenate([_ids(x) for x in links["ends"]])
        far = np.concatenate([_xy(sent[s][0]) for s in links["far"]])
        there = np.concatenate([~np.isin(np.arange(len(sent[s][0]) // 16), np.frombuffer(sent[s][1], "<u4")) for s in links["far"]])
        place = _place(own, ids)
        head, tail = np.repeat(np.arange(len(ids)), np.frombuffer(links["counts"], "<u4")), np.frombuffer(links["tails"], "<u4")
        kept = (place[head] >= 0) & there[tail]
        used, head = np.unique(head[kept], return_inverse=True)
        if not len(used):
            return y
        tail = tail[kept]
        rng = np.random.default_rng([seed, int(ids[used[0]]) & 0xFFFFFFFF])
        y = y.copy()
        y[place[used]] = _epochs(y[place[used]], head, _place(ids[used], ends)[tail], far[tail], (np.frombuffer(links["w"], "<f8") / top)[kept], sample, a, b, alphas, rng)
        return y

    def move(key: tuple, links: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        own = sent[sent["sender"] == -1]
        if own.empty:
            return pd.DataFrame({"block": [], "ids": [], "xy": []})
        ids, xy = own.iloc[0]["ids"], own.iloc[0]["xy"]
        if len(links):
            xy = moved(links.iloc[0], _ids(ids), _xy(xy), dict(zip(sent["sender"], zip(sent["xy"], sent["absent"], strict=True), strict=True))).tobytes()
        return pd.DataFrame({"block": [key[0]], "ids": [ids], "xy": [xy]})

    return move


class Waves:
    """What `run` makes of each wave, as tables in the shared folder until `drop`; one wave after another."""

    def __init__(self, waves: int, run: Callable[[int], DataFrame], label: str):
        self.stored = [Stored(run(wave), label) for wave in range(waves)]
        self.df = reduce(DataFrame.union, [one.df for one in self.stored])

    def drop(self) -> None:
        for one in self.stored:
            one.drop()


def layout(links: DataFrame, start: DataFrame, rounds: int = 8, epochs: int = 25, spread: float = 1.0, least: float = 0.1, seed: int = 0, block: int = BLOCK, spent: Stored | None = None) -> DataFrame:
    """links (a, b, w) and start (id, x, y) of one graph -> id, x, y.

    A point without links stays where it is. A point's links are bounded by its neighbours and those whose neighbour it
    is; of a point that very many have as theirs, its block has each. `links` are read once a wave; `spent` is dropped as
    soon as that is done.
    """
    spark = links.sparkSession
    ship(spark)
    a, b = curve(spread, least)
    given = Stored(start.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("id IS NOT NULL"), "start")
    blocks = max(1, -(-given.df.count() // block))
    waves = -(-blocks // (TURNS * spark.sparkContext.defaultParallelism))

    def of(point: Column | str) -> Column:
        return F.pmod(F.xxhash64(point), F.lit(blocks)).cast("int")

    def dealt(wave: int) -> DataFrame:
        ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w")).where("a IS NOT NULL AND b IS NOT NULL")
        rows = ends.where(F.pmod(of("a"), F.lit(waves)) == wave).select(of("a").alias("block"), of("b").alias("far"), "a", "b", "w")
        types = [pa.int32(), *[pa.binary()] * 4, pa.float64(), pa.list_(pa.int32()), pa.list_(pa.binary())]
        return rows.repartition("block").sortWithinPartitions("block", "a", "b").mapInArrow(_by_block(_packed_links, ["block", "ids", "counts", "tails", "w", "top", "far", "ends"], types), LINKS)

    rows = given.df.select(of("id").alias("block"), "id", "x", "y").repartition("block").sortWithinPartitions("block", "id")
    now = Waves(1, lambda _: rows.mapInArrow(_by_block(_packed_places, ["block", "ids", "xy"], [pa.int32(), pa.binary(), pa.binary()]), PLACES), "places")
    given.drop()
    own = Waves(waves, dealt, "links")
    if spent is not None:
        spent.drop()
    top = own.df.agg(F.max("top")).first()[0]
    points = lambda: now.df.select("ids", "xy").mapInArrow(_unpacked_places, "id long, x double, y double")
    for turn in range(rounds if top else 0):
        alphas = [1 - (turn * epochs + i) / (rounds * epochs) for i in range(epochs)]
        # SAMPLE rows, whatever the table's size.
        sample = np.array([(r["x"], r["y"]) for r in points().orderBy(F.xxhash64("id", F.lit(seed + turn))).limit(SAMPLE).collect()])

        def after(wave: int) -> DataFrame:
            mine = own.stored[wave].df
            wanted = mine.select(F.col("block").alias("to"), F.explode(F.arrays_zip("far", "ends")).alias("p")).select(F.col("p.far").alias("block"), "to", "p.ends")
            sent = now.df.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(_sender(waves, wave), SENT)  # noqa: B023
            return mine.drop("top").groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(_mover(sample, top, a, b, alphas, seed * 1000 + turn), PLACES)  # noqa: B023

        before, now = now, Waves(waves, after, "places")
        before.drop()
    own.drop()
    out = cut(points())
    now.drop()
    return out


def umap(vectors: DataFrame, k: int = 15, rounds: int = 8, epochs: int = 25, least: float = 0.1, seed: int = 0, block: int = BLOCK, state: str = "state") -> DataFrame:
    """(id, state) -> id, projected: all vectors as one graph, from their principal components on."""
    from lumenfold.operators.geometry import pca

    stored = Stored(vectors.select(F.lit(0).alias("group"), F.col("id").cast("long").alias("id"), F.transform(state, lambda x: x.cast("double")).alias("state")).where("id IS NOT NULL AND state IS NOT NULL"), "points")
    points = stored.df
    if points.limit(3).count() < 3:
        few = cut(points.select("id", F.array(F.col("id") * 0.0, F.col("id") * 0.0).alias("projected")))
        stored.drop()
        return few
    flat = Stored(pca(points, 2).select("id", F.get("projected", F.lit(0)).alias("x"), F.get("projected", F.lit(1)).alias("y")), "flat")
    one = Stored(weighed(neighbour_lists(points, k, spent=stored)), "weights")
    wide = flat.df.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))).first()[0] or 1.0
    start = flat.df.select("id", (F.col("x") * (10 / wide)).alias("x"), (F.col("y") * (10 / wide)).alias("y"))
    out = layout(united(one.df), start, rounds, epochs, 1.0, least, seed, block, one)
    flat.drop()
    return out.select("id", F.array("x", "y").alias("projected"))
