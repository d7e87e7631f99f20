"""Queries that run as streams over stores that grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.plans.tracing import traces
from lumenfold.session import read_table, shared_path
from lumenfold.streaming import appended, intake

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return keep


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def appended_counts(spark, sf):
    # A streaming source lists a folder; the pattern picks the one table of it.
    events = read_table(spark, sf, "events")
    return appended.counts(spark, f"{sf}/events.parquet*", events.schema, ["event_type"])


@query("""SELECT event_type, count(*) FILTER (event_id % 3 < 2) AS n_before, count(*) AS n, (SELECT count(*) FROM events WHERE event_id % 3 < 2) AS first_call, (SELECT count(*) FROM events WHERE event_id % 3 = 2) AS second_call, 0::BIGINT AS third_call FROM events GROUP BY 1""")
def appended_increments(spark, sf):
    """A store that grows between calls: what each call reads, and the counts after it."""
    events, store = read_table(spark, sf, "events"), shared_path(spark, "growing")
    events.limit(0).write.parquet(store)
    own = appended.Counts(spark, store, events.schema, ["event_type"], shared_path(spark, "growing-counts"), files=4)
    events.where("event_id % 3 < 2").write.mode("append").parquet(store)
    first, before = own.catch_up(), own.read().withColumnRenamed("n", "n_before")
    before = spark.createDataFrame(before.collect(), before.schema)  # a row a key: the folder's totals are about to grow
    events.where("event_id % 3 = 2").write.mode("append").parquet(store)
    second, third = own.catch_up(), own.catch_up()
    calls = {"first_call": first, "second_call": second, "third_call": third}
    return own.read().join(before, "event_type", "left").withColumns({name: F.lit(n).cast("long") for name, n in calls.items()} | {"n_before": F.coalesce("n_before", F.lit(0))})


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_counts(spark, sf):
    rows = appended.windowed(read_table(spark, sf, "events"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


LATE = "event_id % 50 = 7"


@query(f"""WITH cut AS (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 AS us FROM events),
e AS (SELECT *, CASE WHEN epoch_us(ts) < us AND NOT {LATE} THEN 0 ELSE 1 END AS batch FROM events, cut),
marks AS (SELECT max(ts) FILTER (batch = 0) - INTERVAL 10 MINUTE AS first, max(ts) - INTERVAL 10 MINUTE AS last FROM e)
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e, marks
WHERE (batch = 0 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > first) AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= last GROUP BY 1, 2""")
def closed_windows(spark, sf):
    """Windows of a stream, in two calls; rows that come after their window was closed are dropped, and open windows wait."""
    events, store = read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), shared_path(spark, "timed")
    us = F.unix_micros("ts")
    cut = events.agg(F.expr("min(unix_micros(ts)) + (max(unix_micros(ts)) - min(unix_micros(ts))) div 2")).first()[0]
    early = (us < (cut or 0)) & F.expr(f"NOT ({LATE})")
    events.limit(0).write.parquet(store)
    source, folder = appended.stream(spark, store, events.schema), shared_path(spark, "windows")
    for part in (early, ~early):
        events.where(part).write.mode("append").parquet(store)
        out = appended.closed_windows(source, folder)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def records(spark, sf):
    """A task's answer a document; states, where its number is that of a vector, are that vector."""
    own = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    doc = F.col("doc_id")
    state = F.when(doc % 17 == 4, F.transform("embedding", lambda x: F.lit(float("nan")))).otherwise(F.col("embedding"))
    token = lambda k: F.struct(F.lit(k).cast("long").alias("token_idx"), F.lit(0).alias("layer"), state.alias("state"))
    rows = traces(spark, sf).join(own, "doc_id", "left")
    made = F.to_json(F.struct("trace_id", "model", "task", "steps", "response_text", "success", "input_tokens", "output_tokens", "thinking_tokens", "total_tokens"))
    trace = F.when(doc % 13 == 5, None).when(doc % 19 == 6, F.substring(made, 1, 20)).otherwise(made)
    return rows.select(
        F.col("task.task_id").alias("task_id"), (doc % 11 != 3).alias("success"), F.when(doc % 11 == 3, F.concat(F.lit("model "), (doc % 2).cast("string"), F.lit(" failed"))).alias("summary"),
        (doc % 4 == 0).alias("capture"), trace.alias("trace"), F.when(F.col("embedding").isNotNull(), F.array(token(0), token(1))).cast(intake.STATES).alias("states"),
    )


@query("""WITH d AS (SELECT doc_id, lang, quality, len([x FOR x IN string_split(text, E'\\n') IF regexp_matches(x, '\\S')]) AS steps, doc_id IN (SELECT vec_id FROM embeddings) AS given FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, CASE WHEN doc_id % 11 = 3 THEN 'model ' || doc_id % 2 || ' failed' WHEN doc_id % 13 = 5 THEN 'no trace' WHEN doc_id % 19 = 6 THEN 'a trace that can''t be read' WHEN given AND doc_id % 17 = 4 THEN 'states that aren''t finite numbers' WHEN doc_id % 4 = 0 AND NOT given THEN 'states asked for and not given' WHEN given AND steps < 2 THEN 'fewer than two steps' END AS reason FROM d),
c AS (SELECT 'kept' AS "by", CASE WHEN reason IS NULL THEN 'kept' ELSE 'refused' END AS "key" FROM r UNION ALL SELECT 'reason', reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT 'states', 'with states' FROM r WHERE reason IS NULL AND given
  UNION ALL SELECT 'outcome', CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failure' ELSE 'unjudged' END FROM r WHERE reason IS NULL UNION ALL SELECT 'backend', CASE WHEN doc_id % 3 = 0 THEN 'local' ELSE 'anthropic' END FROM r WHERE reason IS NULL UNION ALL SELECT 'dataset', lang FROM r WHERE reason IS NULL AND lang IS NOT NULL)
SELECT "by", "key", count(*) AS n, (SELECT count(*) FROM r WHERE reason IS NULL) AS stored FROM c GROUP BY 1, 2""")
def trace_intake(spark, sf):
    """Records taken in by a stream, in two calls: counts by outcome, and how many traces the store has."""
    path = shared_path(spark, "answers")
    records(spark, sf).limit(0).write.parquet(path)
    taken = intake.Intake(spark, path, shared_path(spark, "intake"), files=3)
    for part in ("pmod(hash(task_id), 2) = 0", "pmod(hash(task_id), 2) = 1 OR task_id IS NULL"):
        records(spark, sf).where(part).write.mode("append").parquet(path)
        taken.catch_up()
    return taken.counts().withColumn("stored", F.lit(len(taken.store)).cast("long"))
