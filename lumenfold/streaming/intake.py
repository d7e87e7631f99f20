"""Streamed intake of answered tasks into a trace store: each record is kept or refused, with a reason, and counted.

A record is a task's answer: task_id, success, summary, capture (were states asked for), trace (its JSON; null where
the answer has none), states (array of token_idx, layer, state; null or empty without). The reasons, the first that
holds:

  the answer's own summary, where it failed; no trace; a trace that can't be read; states that aren't finite numbers;
  states asked for and not given; fewer than two steps of a trace with states, since velocities need two.

A batch's folders carry its number: states first, then traces, refused records, counts. A batch that broke off and is
tried again takes the place of all of them, so nothing is kept or counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.traces import TRACE, TraceStore
from lumenfold.streaming.appended import Totals, catch_up, cells, stream

STATES = "array<struct<token_idx: long, layer: int, state: array<float>>>"
RECORD = f"task_id string, success boolean, summary string, capture boolean, trace string, states {STATES}"
#: What no trace goes without.
MANDATORY = ("trace_id", "model", "task", "steps", "response_text")


def refusal() -> Column:
    """Why a record, with its trace `read`, is refused; null where it is kept."""
    whole = F.lit(True)
    for name in MANDATORY:
        whole = whole & F.col(f"read.{name}").isNotNull()
    given = F.coalesce(F.size("states"), F.lit(0)) > 0
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.forall("states", lambda s: (F.coalesce(F.size(s["state"]), F.lit(0)) > 0) & F.coalesce(F.forall(s["state"], finite), F.lit(False)))
    return (
        F.when(~F.coalesce("success", F.lit(False)), F.coalesce(F.nullif("summary", F.lit("")), F.lit("failed without a summary")))
        .when(F.coalesce(F.col("trace"), F.lit("")) == "", "no trace")
        .when(~F.coalesce(whole, F.lit(False)), "a trace that can't be read")
        .when(given & ~F.coalesce(sound, F.lit(False)), "states that aren't finite numbers")
        .when(F.coalesce("capture", F.lit(False)) & ~given, "states asked for and not given")
        .when(given & (F.coalesce(F.size("read.steps"), F.lit(0)) < 2), "fewer than two steps")
    )


class Intake:
    """Of a store's folder: `catch_up` takes in the records that are new, `counts` tells them by outcome."""

    def __init__(self, spark: SparkSession, path: str, folder: str, fmt: str = "parquet", files: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.source = stream(spark, path, RECORD, fmt, files)
        self.store = TraceStore(spark, f"{self.folder}/store")
        self.totals = Totals(spark, f"{self.folder}/totals", "by string, key string, n long", ["by", "key"])

    def take(self, records: DataFrame, batch: int) -> None:
        name = f"batch-{batch:09d}"
        # Read several times; each is a small part of a stream.
        judged = records.withColumn("read", F.from_json("trace", TRACE)).withColumn("reason", refusal()).persist()
        try:
            kept = judged.where("reason IS NULL")
            states = kept.select(F.col("read.trace_id").alias("trace_id"), F.inline("states"))
            self.store.append(kept.select("read.*"), states, name)
            judged.where("reason IS NOT NULL").select("task_id", "reason").write.mode("overwrite").parquet(f"{self.folder}/refused/batch={name}")
            here = F.col("reason").isNull()
            outcome = F.when(F.col("read.success"), "success").when(~F.col("read.success"), "failure").otherwise("unjudged")
            counted = cells(
                kept=F.when(here, "kept").otherwise("refused"), states=F.when(here & (F.size("states") > 0), "with states"), outcome=F.when(here, outcome), backend=F.when(here, F.col("read.model.backend")),
                dataset=F.when(here, F.col("read.task.dataset")), reason=F.col("reason"),
            )
            self.totals.add(judged.select(F.inline(counted)).groupBy("by", "key").agg(F.count(F.lit(1)).alias("n")), batch)
        finally:
            judged.unpersist()

    def catch_up(self) -> int:
        """Takes in what is new; how many records that were."""
        rows = catch_up(self.source, self.folder, self.take)
        self.totals.merge()
        return rows

    def counts(self) -> DataFrame:
        """by (kept, states, outcome, backend, dataset, reason), key, n, of all records so far."""
        return self.totals.read()

    def refused(self) -> DataFrame:
        return self.spark.read.schema("task_id string, reason string, batch string").parquet(f"{self.folder}/refused").drop("batch")
