"""Session factory and the few cluster-wide helpers that every module shares."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Bytes of a batch of rows that goes to a Python worker; workers hold a few copies of one.
BATCH_BYTES = 8_000_000


def session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenfold")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LUMENFOLD_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it comes from fewer files than there are cores; costly work on rows would otherwise wait
    for one task of a small table. Larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local master may go without the setting and gets a
    folder of its own; on a cluster that would be a folder that other machines don't see, and is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        folder = tempfile.mkdtemp(prefix="lumenfold-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Whether a plan's shuffle files go when it has run; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Plans that are made here leave no shuffle files when they have run."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def passing(df: DataFrame) -> DataFrame:
    """df as a plan of its own that is checkpointed once and leaves no shuffle files."""
    with cleaning(df.sparkSession):
        return df.select("*")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clean_cut(df: DataFrame) -> DataFrame:
    """`cut`, and the shuffle files that it took go at once."""
    shared_dir(df.sparkSession)
    return passing(df).checkpoint(eager=True)


class Stored:
    """A frame as a table in the shared folder, until `drop`: for what is superseded while a job still runs."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.path = df.sparkSession, shared_path(df.sparkSession, label)
        # A write makes a plan of its own, so the setting must hold while it runs.
        with cleaning(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def append(self, df: DataFrame) -> None:
        with cleaning(self.spark):
            df.write.mode("append").parquet(self.path)
        self.df = self.spark.read.schema(self.df.schema).parquet(self.path)

    def drop(self) -> None:
        discard(self.spark, self.path)


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own that nothing reads any more, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application, in batches of a bounded size: BATCH_BYTES
    where the session has Spark's own default."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_lumenfold_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, str(path.relative_to(PACKAGE.parent)))
    target = Path(tempfile.mkdtemp(prefix="lumenfold-ship-")) / "lumenfold.zip"
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))
    context._lumenfold_shipped = True
