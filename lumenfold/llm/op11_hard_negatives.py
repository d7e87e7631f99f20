"""Hard-negative mining by distributed radix selection.

Rows lie in blocks, and so do anchors; a block of anchors meets every block of rows, and scores are made by a matrix
product and never stored. What is wanted of an anchor is a window: the first k rows, by score from the top and then by
id, of those with a score in a range and the anchor's label (positives) or another one (negatives). A pass counts each
open window's rows by the leading digit of their distance from the window's top; sums of those histograms locate the
bucket that holds the k-th row, and the next pass counts its next digit. Where a score has more rows than wanted, as
copies of a vector have, the digits of the id follow. A window with few rows down to its bucket is closed; at the end
one pass gathers the rows that qualify, no more than k of a window from each block, and ranks them.

A block need not tell buckets beyond its own k-th row, since the k-th row of all can't lie there; so a histogram has a
few entries, whatever the number of rows.

Rows without id, label or vector, or with a component that is null or not finite, take no part. Repeated rows are rows
of their own, but a row with the anchor's id is none of its other rows. Components beyond the length of the other
vector count nothing. Ties go by id. An empty table, no anchors or no rows in a window give no rows. Scores that don't
fit a long are an error. Other columns take no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.session import cut, discard, read_table, shared_path, ship

#: Rows and anchors of a block at most, and its bytes, which count where vectors are long.
BLOCK_ROWS, BLOCK_ANCHORS, BLOCK_BYTES = 16_384, 1_024, 8_000_000
#: Bits of a digit; rows of a window, beyond the wanted ones, from which it is refined further; scores at a time.
BITS, GATHER, SCORES = 8, 64, 1 << 20
BLOCK = "block long, ids array<long>, labels array<long>, norms array<double>, d int, vectors binary"
WINDOW = ("w", "slot", "lo", "hi", "s_lo", "s_hi", "i_lo", "i_hi", "taken")


def whole_vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, matrix): floor(scale * x) of each usable row's components, short rows filled with zeros."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float) if len(flat) else np.zeros(0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    usable = np.asarray(column.is_valid()) & (np.bincount(row, ~np.isfinite(values), len(sizes)) == 0)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = usable[row]
    whole = np.floor(scale * values[kept])
    if len(whole) and np.abs(whole).max() >= 2.0**62:
        raise OverflowError("a component doesn't fit a long")
    out = np.zeros((len(sizes), int(sizes[usable].max(initial=0))), np.int64)
    out[row[kept], place[kept]] = whole.astype(np.int64)
    return usable, out[usable]


def _packer(most: int, scale: int):
    """Blocks of usable rows; a block's number is its partition's and its place there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, held, n
            d = max(x.shape[1] for _, _, x in held)
            vectors = np.concatenate([np.pad(x, ((0, 0), (0, d - x.shape[1]))) for _, _, x in held])
            norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
            ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            arrays = [pa.array([number]), *(pa.array([x]) for x in (ids, labels, norms)), pa.array([d], pa.int32()), pa.array([vectors.astype("<i8").tobytes()])]
            number, held, n = number + 1, [], 0
            return pa.RecordBatch.from_arrays(arrays, ["block", "ids", "labels", "norms", "d", "vectors"])

        for batch in batches:
            usable, vectors = whole_vectors(batch.column(2), scale)
            ids, labels = (batch.column(k).filter(pa.array(usable)).to_numpy(zero_copy_only=False) for k in (0, 1))
            step = max(1, min(most, BLOCK_BYTES // (8 * max(1, vectors.shape[1]))))
            at = 0
            while at < len(ids):
                take = min(step - n, len(ids) - at) if n < step else 0
                if take:
                    held.append((ids[at : at + take], labels[at : at + take], vectors[at : at + take]))
                    n, at = n + take, at + take
                if n >= step:
                    yield block()
        if held:
            yield block()

    return pack


def _bits(x: np.ndarray) -> np.ndarray:
    """Binary digits of unsigned numbers."""
    out = np.zeros(x.shape, np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        large = x >= np.uint64(1) << np.uint64(step)
        x, out = np.where(large, x >> np.uint64(step), x), out + np.where(large, np.uint64(step), np.uint64(0))
    return out + (x > 0)


def _shift(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By how many bits the places between low and high go to the right, for digits of BITS bits."""
    return np.maximum(_bits((high - low).astype(np.int64).view(np.uint64)).astype(np.int64) - BITS, 0).astype(np.uint64)


def _cells(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of each joined row: the anchors' block and windows, and the rows' ids, labels and vectors."""
    at = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    longs = lambda name, k: at[name][k].values.to_numpy(zero_copy_only=False)
    matrix = lambda name, d, n, k: np.frombuffer(at[name][k].as_py(), "<i8").reshape(n, at[d][k].as_py())
    for k in range(batch.num_rows):
        ids, own = longs("ids", k), longs("a_ids", k)
        windows = {f: at["windows"][k].values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in WINDOW}
        yield at["a_block"][k].as_py(), windows, own, longs("a_labels", k), matrix("a_vectors", "a_d", len(own), k), ids, longs("labels", k), matrix("vectors", "d", len(ids), k)


def _found(cell: tuple, same: bool, low: str, high: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, row, score) of the rows with a score from `low` to `high` of a window, some windows at a time."""
    _, windows, own, own_labels, anchors, ids, labels, vectors = cell
    d = min(anchors.shape[1], vectors.shape[1])
    anchors, vectors = anchors[:, :d], vectors[:, :d]
    bound = math.prod(int(np.abs(x).max(initial=0)) for x in (anchors, vectors)) * max(d, 1)
    if bound >= 1 << 63:
        raise OverflowError("a score doesn't fit a long")
    exact = float if bound < 1 << 53 else np.int64
    across = vectors.astype(exact).T
    order = np.argsort(windows["slot"], kind="stable")
    slots, first = np.unique(windows["slot"][order], return_index=True)
    last = np.append(first[1:], len(order))
    lowest, highest = (f.reduceat(windows[x][order], first) if len(order) else order for f, x in ((np.minimum, low), (np.maximum, high)))
    step = max(1, SCORES // max(1, len(ids)))
    for at in range(0, len(slots), step):
        part = slice(at, at + step)
        few, begin, stop = slots[part], first[part], last[part]
        scores = anchors[few].astype(exact) @ across
        alike = own_labels[few][:, None] == labels[None, :]
        meant = alike & (own[few][:, None] != ids[None, :]) if same else ~alike
        a, r = np.nonzero(meant & (scores >= lowest[part, None]) & (scores <= highest[part, None]))
        s = scores[a, r].astype(np.int64)
        for j in range(int((stop - begin).max())):
            has = begin + j < stop
            w = order[np.minimum(begin + j, stop - 1)][a]
            inside = has[a] & (s >= windows[low][w]) & (s <= windows[high][w])
            yield w[inside], r[inside], s[inside]


def _counter(same: bool, k: int):
    """Histograms of open windows: block, w, digit, first and last place of the bucket, rows in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in _cells(batch):
                block, windows, ids = cell[0], cell[1], cell[5]
                by_score = windows["s_lo"] < windows["s_hi"]
                low = np.where(by_score, windows["s_lo"], windows["i_lo"])
                high = np.where(by_score, windows["s_hi"], windows["i_hi"])
                shift = _shift(low, high)
                n = np.zeros((len(low), 1 << BITS), np.int64)
                for w, r, s in _found(cell, same, "s_lo", "s_hi"):
                    place = np.where(by_score[w], windows["s_hi"][w] - s, ids[r] - windows["i_lo"][w])
                    inside = by_score[w] | (ids[r] >= windows["i_lo"][w]) & (ids[r] <= windows["i_hi"][w])
                    w, place = w[inside], place[inside]
                    digit = (place.view(np.uint64) >> shift[w]).astype(np.int64)
                    np.add.at(n.reshape(-1), (w << BITS) + digit, 1)
                # A bucket beyond a block's own k-th row can't hold the k-th of all.
                before = n.cumsum(1) - n
                w, digit = np.nonzero((n > 0) & (before < (k - windows["taken"])[:, None]))
                width = np.left_shift(np.int64(1), shift[w].astype(np.int64))
                score, off = by_score[w], digit * width
                first = np.where(score, high[w] - off, low[w] + off)
                final = np.where(score, np.maximum(low[w], first - (width - 1)), np.minimum(high[w], first + (width - 1)))
                arrays = (np.full(len(w), block, np.int64), windows["w"][w], digit, first, final, n[w, digit])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["block", "w", "digit", "first", "final", "n"])

    return count


def _gatherer(same: bool, k: int):
    """Rows that qualify: those before a closed window's bucket and in it, the first k of each window and block."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in _cells(batch):
                block, windows, ids = cell[0], cell[1], cell[5]
                parts = []
                for w, r, s in _found(cell, same, "s_lo", "hi"):
                    exact = windows["s_lo"][w] == windows["s_hi"][w]
                    kept = ~exact | (s > windows["s_lo"][w]) | (ids[r] <= windows["i_hi"][w])
                    parts.append((w[kept], ids[r[kept]], s[kept]))
                w, i, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
                order = np.lexsort((i, -s, w))
                w, i, s = w[order], i[order], s[order]
                begin = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
                kept = np.arange(len(w)) - np.repeat(begin, np.diff(np.append(begin, len(w)))) < k
                arrays = (np.full(kept.sum(), block, np.int64), windows["w"][w[kept]], i[kept], s[kept])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["block", "w", "id", "score"])

    return gather


class Selection:
    """Rows and anchors in blocks, and the selection of windows' first rows among them."""

    def __init__(self, rows: DataFrame, anchors: Column, scale: int, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS):
        """rows: i, l, v; anchors: which of them."""
        self.spark = rows.sparkSession
        ship(self.spark)
        self.folders = [shared_path(self.spark, name) for name in ("rows", "anchors")]
        queries = rows.where(anchors & F.col("i").isNotNull() & F.col("l").isNotNull() & F.col("v").isNotNull())
        groups = max(1, -(-queries.count() // block_anchors))
        known = rows.where("i IS NOT NULL AND l IS NOT NULL")
        known.mapInArrow(_packer(block_rows, scale), BLOCK).write.parquet(self.folders[0])
        queries.repartition(groups).mapInArrow(_packer(block_anchors, scale), BLOCK).write.parquet(self.folders[1])
        self.rows, self.anchors = (self.spark.read.parquet(f) for f in self.folders)
        one = self.rows.agg(F.max(F.array_max("norms")), F.min(F.array_min("ids")), F.max(F.array_max("ids")), F.count(F.lit(1))).first()
        self.norm, self.least, self.most, self.blocks = one[0] or 0.0, one[1] or 0, one[2] or 0, max(1, one[3])

    def windows(self, ranges: DataFrame) -> DataFrame:
        """block, w, slot, lo, hi -> open windows over all ids."""
        return cut(ranges.where("lo <= hi").selectExpr("block", "w", "slot", "lo", "hi", "lo AS s_lo", "hi AS s_hi", f"{self.least}L AS i_lo", f"{self.most}L AS i_hi", "0L AS taken"))

    def _pass(self, windows: DataFrame, work, schema: str) -> DataFrame:
        """The work over every block of rows and every block of anchors that has windows; a copy of it for each block of
        rows meets it there, since those are the larger ones."""
        few = windows.groupBy("block").agg(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in WINDOW))).alias("windows"))
        own = self.anchors.select(F.col("block").alias("a_block"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("d").alias("a_d"), F.col("vectors").alias("a_vectors"))
        left = own.join(few, F.col("a_block") == F.col("block")).drop("block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        right = self.rows.select(F.pmod(F.hash("block"), F.lit(self.blocks)).alias("salt"), "ids", "labels", "d", "vectors")
        return left.join(right, "salt").drop("salt").mapInArrow(work, schema)

    def first(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """block, w, id, score, rank: each window's first k rows."""
        closed, found = [], self.windows(windows)
        while True:
            counts = self._pass(found, _counter(same, k), "block long, w long, digit long, first long, final long, n long")
            summed = counts.groupBy("block", "w", "digit").agg(F.first("first").alias("first"), F.first("final").alias("final"), F.sum("n").alias("n"))
            upto = summed.withColumn("upto", F.sum("n").over(Window.partitionBy("block", "w").orderBy("digit")))
            # The bucket of the k-th row, or the last one's end where there are fewer rows.
            open_ = found.select("block", "w", "slot", "lo", "hi", "s_lo", "s_hi", "i_lo", "i_hi", "taken")
            located = upto.join(open_, ["block", "w"]).withColumn("reached", F.col("taken") + F.col("upto") >= k)
            best = F.min_by(F.struct("first", "final", "n", "upto"), F.when(F.col("reached"), F.col("digit")))
            one = located.groupBy("block", "w", "slot", "lo", "hi", "s_lo", "s_hi", "i_lo", "i_hi", "taken").agg(best.alias("b"))
            by_score = F.col("s_lo") < F.col("s_hi")
            reached = F.col("b").isNotNull()
            moved = one.select(
                "block", "w", "slot", "lo", "hi",
                F.when(reached & by_score, F.col("b.final")).otherwise(F.col("s_lo")).alias("s_lo"), F.when(reached & by_score, F.col("b.first")).otherwise(F.col("s_hi")).alias("s_hi"),
                F.when(reached & ~by_score, F.col("b.first")).otherwise(F.col("i_lo")).alias("i_lo"), F.when(reached & ~by_score, F.col("b.final")).otherwise(F.col("i_hi")).alias("i_hi"),
                F.when(reached, F.col("taken") + F.col("b.upto") - F.col("b.n")).otherwise(F.col("taken")).alias("taken"),
                (~reached | (F.col("taken") + F.col("b.upto") <= k + GATHER)).alias("few"),
            )
            now = cut(moved.withColumn("done", F.col("few") | (F.col("s_lo") == F.col("s_hi")) & (F.col("i_lo") == F.col("i_hi"))).drop("few"))
            closed.append(now.where("done").drop("done"))
            found = now.where("NOT done").drop("done")
            if found.isEmpty():
                break
        ends = closed[0]
        for more in closed[1:]:
            ends = ends.union(more)
        got = self._pass(ends, _gatherer(same, k), "block long, w long, id long, score long")
        return got.withColumn("rank", F.row_number().over(Window.partitionBy("block", "w").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    def close(self) -> None:
        for folder in self.folders:
            discard(self.spark, folder)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """rows: i (id), l (label), v (vector); anchors: a condition on i and l. anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score: for each anchor and each of its first positives the first negatives whose score is
    `low` to `high` hundredths of the positive's."""
    chosen = Selection(rows.select(F.col("i").cast("long"), F.col("l").cast("long"), "v"), anchors, scale, block_rows, block_anchors)
    slots = chosen.anchors.select("block", F.posexplode(F.arrays_zip("ids", "norms")).alias("slot", "a"))
    # No score is larger than the product of lengths.
    top = (F.floor(F.col("a.norms") * F.lit(chosen.norm * (1 + 1e-9))) + 1).cast("long")
    near = chosen.first(slots.select("block", F.col("slot").cast("long").alias("w"), "slot", (-top).alias("lo"), top.alias("hi")), True, positives)
    pairs = cut(near.select("block", F.col("w").alias("slot"), (F.col("w") * positives + F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    ranges = pairs.selectExpr("block", "w", "slot", f"-((-positive_score * {low} - pmod(-positive_score * {low}, 100)) div 100) AS lo", f"(positive_score * {high} - pmod(positive_score * {high}, 100)) div 100 AS hi")
    far = chosen.first(ranges, False, negatives)
    names = slots.select("block", F.col("slot").cast("long").alias("slot"), F.col("a.ids").alias("anchor_id"))
    out = far.select("block", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["block", "w"]).join(names, ["block", "slot"])
    done = cut(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    chosen.close()
    return done


SQL = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, a.label = b.label AS alike, b.id, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE alike) WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), label.alias("l"), F.col("embedding").alias("v"))
    return hard_negatives(rows, F.col("i") % 100 == 0)
