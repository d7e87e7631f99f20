"""Totals over append-only stores, kept up by streams that catch up and stop.

A folder that the caller names holds all that lasts: the offsets, which are Spark's own checkpoint of the files that
were read, and the totals, as a table of what each batch adds. A batch that is tried again writes its own folder again,
so it counts once however often it ran; a later call reads only files that are new. Now and then the batches' tables
are merged into one, which replaces them by its name alone, so a merge that breaks off changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.session import discard, shared_path

#: Batches' tables that are kept apart.
APART = 32


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The finished tables at a path, by the number in their name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for status in store.listStatus(place) if store.exists(place) else ():
        own = status.getPath()
        if (name := re.fullmatch(r"upto-(\d+)", own.getName())) and store.exists(spark._jvm.org.apache.hadoop.fs.Path(own, "_SUCCESS")):
            out[int(name[1])] = own.toString()
    return out


class Totals:
    """Sums by key that grow batch by batch. Values are numbers that add up; null keys are a key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, keys: Sequence[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _parts(self) -> tuple[int, list[str]]:
        merged, apart = _folders(self.spark, f"{self.folder}/merged"), _folders(self.spark, f"{self.folder}/apart")
        last = max(merged, default=-1)
        return max([last, *apart]), [merged[k] for k in merged if k == last] + [path for batch, path in sorted(apart.items()) if batch > last]

    def _sums(self, rows: DataFrame) -> DataFrame:
        values = [f.name for f in self.schema.fields if f.name not in self.keys]
        return rows.groupBy(*self.keys).agg(*(F.sum(v).cast(self.schema[v].dataType).alias(v) for v in values)).select(*self.schema.names)

    def add(self, rows: DataFrame, batch: int) -> None:
        """What a batch adds; the same batch again takes the place of its first try."""
        self._sums(rows).write.mode("overwrite").parquet(f"{self.folder}/apart/upto-{batch}")

    def read(self) -> DataFrame:
        _, parts = self._parts()
        return self._sums(self.spark.read.schema(self.schema).parquet(*parts)) if parts else self.spark.createDataFrame([], self.schema)

    def merge(self, most: int = APART) -> None:
        """Merge where more than `most` tables lie apart. Only for when no batch is running, as batches that are merged
        can't be tried again."""
        last, parts = self._parts()
        if len(parts) <= most:
            return
        self.read().write.mode("overwrite").parquet(f"{self.folder}/merged/upto-{last}")
        for path in parts:
            discard(self.spark, path)


def catch_up(source: DataFrame, folder: str, work: Callable[[DataFrame, int], None]) -> int:
    """Runs the work over a stream's batches that are new since the folder's last call; how many rows they had.

    A batch of which the work failed is the first of the next call, with the same number and the same files.
    """
    run = source.writeStream.option("checkpointLocation", f"{folder.rstrip('/')}/offsets").trigger(availableNow=True).foreachBatch(work).start()
    run.awaitTermination()
    return sum(p["numInputRows"] for p in run.recentProgress)


def stream(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """A store as a stream of its files, some to a batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


class Counts:
    """Records of a store by key, read once each: `catch_up` reads what is new, `read` gives the counts so far.

    The store holds nothing of the records, only a number a key and batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: Sequence[str], folder: str, fmt: str = "parquet", files: int | None = None):
        self.source, self.folder = stream(spark, path, schema, fmt, files), folder
        fields = [self.source.schema[k] for k in keys]
        self.totals = Totals(spark, f"{folder.rstrip('/')}/totals", T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("n", T.LongType())]), keys)

    def catch_up(self) -> int:
        rows = catch_up(self.source, self.folder, lambda df, batch: self.totals.add(df.groupBy(*self.totals.keys).agg(F.count(F.lit(1)).alias("n")), batch))
        self.totals.merge()
        return rows

    def read(self) -> DataFrame:
        return self.totals.read()


def counts(spark: SparkSession, path: str, schema: str | T.StructType, keys: Sequence[str], fmt: str = "parquet", folder: str | None = None) -> DataFrame:
    """Records so far by key. With a folder, only those are read that its last call hadn't seen."""
    own = Counts(spark, path, schema, keys, folder or shared_path(spark, "counts"), fmt)
    own.catch_up()
    return own.read()


def windowed(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling counts and sums of a stream or table, late rows dropped by watermark on a stream."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    return rows.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def closed_windows(events: DataFrame, folder: str, **how) -> DataFrame:
    """The windows of a stream that no row can reach any more, written once each to the folder; a later call goes on
    from where the last one stopped. Open windows are kept as the stream's state."""
    folder, flat = folder.rstrip("/"), windowed(events, **how)
    flat = flat.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in flat.columns if c != "window"))
    run = flat.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    run.awaitTermination()
    return events.sparkSession.read.schema(flat.schema).parquet(f"{folder}/windows")


def cells(**of: Column) -> Column:
    """array<struct<by, key>> of a row's values by name, for counts by each of them at once; null values count as none."""
    listed = F.array(*(F.struct(F.lit(name).alias("by"), value.cast("string").alias("key")) for name, value in of.items()))
    return F.filter(listed, lambda c: c["key"].isNotNull())
