"""Sharding: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Which rows of a partition go to which shard is a draw without replacement, so the counts by partition and shard are
a multivariate hypergeometric matrix whose row sums are the partitions' sizes and whose column sums the shards'.
Partitions split in halves down a tree; each node's draw depends on the seed and the node alone, so a task draws its
own row of the matrix, the same after a lost executor. A task then permutes its rows' destinations; rows are
exchanged; the receiver permutes again. A large shard is several cells of bounded size, drawn in the same way, so no
task holds a whole shard.

Sizes: counts of shards differ by one row at most (law `rows`). Rows are dealt one by one, whatever their columns
hold: nulls, very long texts, equal rows and clashing names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.session import cut, read_table, ship

SHARDS = 40
CELL_ROWS = 100_000
CELLS = 65_536
#: numpy's own draw holds below this population.
NUMPY_MOST = 1_000_000_000


def _large(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Hypergeometric by ratio of uniforms about the mode, for populations that numpy's draw doesn't take."""
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mean = sample * good / total
    spread = math.sqrt(max(mean * (bad / total) * (total - sample) / (total - 1), 0.25))
    log = lambda k: -sum(map(math.lgamma, (k + 1, good - k + 1, sample - k + 1, bad - sample + k + 1)))
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    top, centre, width = log(mode), mean + 0.5, 2.0 * math.sqrt(2.0 / math.e) * math.sqrt(spread**2 + 0.5) + (3 - 2 * math.sqrt(3 / math.e))
    while True:
        u, v = rng.random(), rng.random()
        if u:
            k = math.floor(centre + width * (v - 0.5) / u)
            if low <= k <= high and 2 * math.log(u) <= log(k) - top:
                return k


def draw(rng: np.random.Generator, cells: np.ndarray, sample: int) -> np.ndarray:
    """How many of `sample` rows, taken without replacement, go to each cell."""
    total = int(cells.sum())
    if total < NUMPY_MOST:
        return rng.multivariate_hypergeometric(cells, sample, method="marginals")
    out = np.zeros_like(cells)
    for i, own in enumerate(map(int, cells)):
        total -= own
        small = own + total < NUMPY_MOST
        out[i] = rng.hypergeometric(own, total, sample) if small else _large(rng, own, total, sample)
        sample -= int(out[i])
    return out


def matrix_row(before: np.ndarray, cells: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """before: rows ahead of each partition, and of the end. Walks from all partitions down to one."""
    low, high, left = 0, len(before) - 1, cells.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        first = draw(np.random.default_rng([seed, low, high]), left, int(before[middle] - before[low]))
        if partition < middle:
            high, left = middle, first
        else:
            low, left = middle, left - first
    return left


def cell_sizes(rows: int, shards: int, cell_rows: int = CELL_ROWS) -> list[tuple[int, int, int]]:
    """(shard, first slot, size) of each cell; sizes of shards differ by one at most, and cells of a shard likewise."""
    most = max(cell_rows, -(-rows // CELLS))
    out = []
    for shard in range(shards):
        size = rows // shards + (shard < rows % shards)
        n = max(1, -(-size // most))
        at = 0
        for k in range(n):
            own = size // n + (k < size % n)
            out.append((shard, at, own))
            at += own
    return out


def _dealer(before: np.ndarray, cells: np.ndarray, seed: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goes, at, rng = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if goes is None:
                partition = batch.column(batch.num_columns - 1)[0].as_py()
                rng = np.random.default_rng([seed, partition, 1 << 31])
                goes = rng.permutation(np.repeat(np.arange(len(cells), dtype=np.int32), matrix_row(before, cells, partition, seed)))
            own = goes[at : at + batch.num_rows]
            at += batch.num_rows
            keys = rng.integers(0, 1 << 62, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.int32()), pa.array(keys, pa.int64())], [*(f"c{i}" for i in range(batch.num_columns - 1)), "_cell", "_key"])

    return deal


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = 17, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df's columns, then shard (int) and slot (long, gapless from 0 in each shard), in uniformly random places.

    df is checkpointed, so that its partitions hold the same rows each time that they are read.
    """
    spark = df.sparkSession
    ship(spark)
    names = df.columns
    fixed = cut(df.toDF(*(f"c{i}" for i in range(len(names)))))
    counts = {r["p"]: r["count"] for r in fixed.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    before = np.concatenate(([0], np.cumsum([counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]))).astype(np.int64)
    cells = cell_sizes(int(before[-1]), shards, cell_rows)
    schema = T.StructType([*fixed.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_key", T.LongType())])
    dealt = fixed.withColumn("_p", F.spark_partition_id()).mapInArrow(_dealer(before, np.array([c[2] for c in cells], np.int64), seed), schema)
    # CELLS + shards rows at most, whatever the input's size.
    places = F.broadcast(spark.createDataFrame([(i, s, a) for i, (s, a, _) in enumerate(cells)], "_cell int, _shard int, _first long"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_key")) - 1
    placed = dealt.withColumn("_rank", rank).join(places, "_cell")
    return placed.select(*(f"c{i}" for i in range(len(names))), F.col("_shard"), (F.col("_first") + F.col("_rank")).cast("long").alias("_slot")).toDF(*names, "shard", "slot")


def write_shards(df: DataFrame, folder: str, shards: int = SHARDS, seed: int = 17) -> None:
    """The shards as Parquet folders shard=k; rows carry their slot. Columns of df named so get an _x."""
    own = df.toDF(*(f"{c}_x" if c in ("shard", "slot") else c for c in df.columns))
    shard_rows(own, shards, seed).write.partitionBy("shard").parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    slim = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"))
    return shard_rows(slim).withColumn("grown_shard", F.lit(None).cast("int"))
