"""Queries of traces, transcripts, states, measurements and appended records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import geometry as g
from lumenfold.operators import measurements as ms
from lumenfold.operators import traces as t
from lumenfold.plans.inputs import STATES_SQL, states
from lumenfold.session import read_table, shared_path, spread

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _segments(rows, how):
    parts = t.segment(rows, how).select("id", F.posexplode("segments").alias("idx", "s"))
    return parts.select("id", "idx", F.col("s.text").alias("segment"), "s.token_start", "s.token_end", "s.kind")


@query(r"""WITH parts AS (SELECT doc_id AS id, text, unnest(string_split(text, E'\n')) AS raw, generate_subscripts(string_split(text, E'\n'), 1) AS k FROM documents),
placed AS (SELECT *, sum(length(raw) + 1) OVER (PARTITION BY id ORDER BY k) - 1 AS upto, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS bare FROM parts),
kept AS (SELECT id, bare, (upto // 4 + 1)::INT AS token_end, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS idx, count(*) OVER (PARTITION BY id) AS n FROM placed WHERE bare <> '')
SELECT id, idx::INT AS idx, bare AS segment, lag(token_end, 1, 0) OVER (PARTITION BY id ORDER BY idx) AS token_start, token_end, CASE WHEN idx = n - 1 THEN 'output' ELSE 'thinking' END AS kind FROM kept""")
def segment_delimiter(spark, sf):
    return _segments(spread(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")), "delimiter")


@query(r"""WITH made AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN ['First ' || doc_id || '.', 'Then more.', 'Repeat.', 'Repeat.', coalesce(text, '') || 'Done ' || source || '.'] WHEN 1 THEN [coalesce(text, '') || ' Plain answer ' || doc_id || ' '] ELSE ['Only.'] END AS p, doc_id % 3 AS kind, coalesce(text, '') AS t FROM documents),
ends AS (SELECT id, kind, p, CASE kind WHEN 0 THEN '<think>' || p[1] || ' ' || p[2] || E'\n' || p[3] || E'\n\n' || p[4] || '</think>' || p[5] WHEN 1 THEN p[1] ELSE '<think>' || p[1] || '</think>' END AS text FROM made),
rows AS (SELECT id, unnest([1, 2, 3, 4, 5]) AS k, p, text, kind FROM ends),
placed AS (SELECT id, k - 1 AS idx, regexp_replace(p[k], '^\s+|\s+$', '', 'g') AS segment, CASE WHEN kind = 1 OR k = 5 THEN length(text) ELSE 7 + length(p[1]) + CASE WHEN k > 1 THEN 1 + length(p[2]) ELSE 0 END + CASE WHEN k > 2 THEN 1 + length(p[3]) ELSE 0 END + CASE WHEN k > 3 THEN 2 + length(p[4]) ELSE 0 END END AS upto, CASE WHEN kind = 1 OR k = 5 THEN 'output' ELSE 'thinking' END AS kind FROM rows WHERE k <= len(p))
SELECT id, idx, segment, lag((upto // 4 + 1)::INT, 1, 0) OVER (PARTITION BY id ORDER BY idx) AS token_start, (upto // 4 + 1)::INT AS token_end, kind FROM placed""")
def segment_tags(spark, sf):
    """Whole texts as answers after thoughts in tags, or without tags; a third has thoughts alone."""
    d, k, own = F.col("doc_id").cast("string"), F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    tagged = F.concat(F.lit("<think>First "), d, F.lit(". Then more.\nRepeat.\n\nRepeat.</think>"), own, F.lit("Done "), F.col("source"), F.lit("."))
    said = F.when(k == 0, tagged).when(k == 1, F.concat(own, F.lit(" Plain answer "), d, F.lit(" "))).otherwise(F.lit("<think>Only.</think>"))
    return _segments(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), said.alias("text")), "tags")


#: Peaks of a table v (trace_id, i, s) and the cuts that they make, for traces whose tokens are in ns (trace_id, n).
CUTS = """med AS (SELECT trace_id, median(s) AS m FROM v GROUP BY 1),
around AS (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS q FROM v WINDOW w AS (PARTITION BY trace_id ORDER BY i)),
top AS (SELECT trace_id, i, s, row_number() OVER (PARTITION BY trace_id ORDER BY s DESC, i DESC) AS k FROM around WHERE s > p AND s > q),
walk AS (SELECT trace_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM ns UNION ALL
  SELECT w.trace_id, t.k, CASE WHEN len([x FOR x IN kept IF abs(x - t.i) < 5]) = 0 THEN list_append(kept, t.i) ELSE kept END FROM walk w JOIN top t ON t.trace_id = w.trace_id AND t.k = w.k + 1),
kept AS (SELECT trace_id, unnest(kept) AS i FROM (SELECT trace_id, arg_max(kept, k) AS kept FROM walk GROUP BY 1)),
high AS (SELECT k.trace_id, k.i, a.s, (SELECT max(b.i) FROM v b WHERE b.trace_id = k.trace_id AND b.i < k.i AND b.s > a.s) AS l, (SELECT min(b.i) FROM v b WHERE b.trace_id = k.trace_id AND b.i > k.i AND b.s > a.s) AS r FROM kept k JOIN v a ON a.trace_id = k.trace_id AND a.i = k.i),
low AS (SELECT h.trace_id, h.i, h.s, (SELECT min(b.s) FROM v b WHERE b.trace_id = h.trace_id AND b.i <= h.i AND (h.l IS NULL OR b.i > h.l)) AS x, (SELECT min(b.s) FROM v b WHERE b.trace_id = h.trace_id AND b.i >= h.i AND (h.r IS NULL OR b.i < h.r)) AS y FROM high h),
places AS (SELECT trace_id, i + 1 AS e FROM low JOIN med USING (trace_id) WHERE s - greatest(x, y) >= m UNION SELECT trace_id, 0 FROM ns UNION SELECT trace_id, n FROM ns),
cuts AS (SELECT trace_id, lag(e) OVER w AS token_start, e AS token_end FROM places WINDOW w AS (PARTITION BY trace_id ORDER BY e))"""
SPEED = "v AS (SELECT trace_id, i, s FROM (SELECT trace_id, token_idx - 1 AS i, list_cosine_distance(lag(state) OVER w, state) AS s FROM inside WINDOW w AS (PARTITION BY trace_id ORDER BY token_idx)) WHERE i >= 0)"


@query(f"WITH RECURSIVE {STATES_SQL}, inside AS (SELECT * FROM states), {SPEED}, ns AS (SELECT trace_id, count(*) AS n FROM inside GROUP BY 1), {CUTS} SELECT trace_id, (row_number() OVER w - 1)::INT AS idx, token_start::INT AS token_start, token_end::INT AS token_end, CASE WHEN token_end = max(token_end) OVER (PARTITION BY trace_id) THEN 'output' ELSE 'thinking' END AS kind FROM cuts WHERE token_start IS NOT NULL WINDOW w AS (PARTITION BY trace_id ORDER BY token_start)")
def segment_velocity(spark, sf):
    return t.velocity_segments(states(spark, sf))


@query(f"WITH RECURSIVE {STATES_SQL}, sizes AS (SELECT trace_id, count(*) AS total FROM states GROUP BY 1), inside AS (SELECT s.* FROM states s JOIN sizes USING (trace_id) WHERE token_idx < total - 5), {SPEED}, ns AS (SELECT trace_id, count(*) AS n FROM inside GROUP BY 1), {CUTS}, rows AS (SELECT trace_id, token_start::INT AS token_start, token_end::INT AS token_end, 'thinking' AS kind FROM cuts WHERE token_start IS NOT NULL UNION ALL SELECT trace_id, (total - 5)::INT, (total - 2)::INT, 'output' FROM sizes) SELECT trace_id, (row_number() OVER (PARTITION BY trace_id ORDER BY token_start) - 1)::INT AS idx, token_start, token_end, kind FROM rows")
def segment_hybrid(spark, sf):
    said = states(spark, sf).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).select("trace_id", F.concat(F.lit("<think>"), F.repeat(F.lit("abc "), F.col("n").cast("int") - 8), F.lit(".</think>Done.")).alias("text"))
    return t.hybrid_segments(said, states(spark, sf))


def _blocks():
    kind = F.get(F.array(*map(F.lit, ("thinking", "image", "tool_use", "text"))), (F.col("turn") % 4).cast("int"))
    body = lambda k: F.when(kind == k, F.col("text"))
    block = F.struct("turn", kind.alias("type"), body("text").alias("text"), body("thinking").alias("thinking"), F.when(kind == "tool_use", F.concat(F.lit("f"), F.col("conv_id").cast("string"))).alias("name"), F.when(kind == "tool_use", F.lit('{"x": 1}')).alias("input"))
    return F.array_sort(F.collect_list(block)).alias("blocks")


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1)::INT AS index, CASE turn % 4 WHEN 2 THEN '{"tool": "f' || conv_id || '", "input": {"x": 1}}' ELSE text END AS text, CASE turn % 4 WHEN 0 THEN 'thinking' WHEN 2 THEN 'tool_call' ELSE 'output' END AS kind FROM conversations WHERE turn % 4 <> 1""")
def content_blocks(spark, sf):
    rows = read_table(spark, sf, "conversations").groupBy("conv_id").agg(_blocks())
    return rows.select("conv_id", F.explode(t.content_steps(F.col("blocks"))).alias("s")).select("conv_id", "s.index", "s.text", "s.kind")


@query("SELECT conv_id, coalesce(string_agg(CASE WHEN turn % 4 = 3 THEN text END, E'\\n' ORDER BY turn, text), '') AS response_text FROM conversations GROUP BY 1")
def response_assembly(spark, sf):
    rows = read_table(spark, sf, "conversations").groupBy("conv_id").agg(_blocks())
    return rows.select("conv_id", t.response_text(t.content_steps(F.col("blocks"))).alias("response_text"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos FROM conversations WHERE turn % 5 <> 0), sys AS (SELECT conv_id, string_agg(text, E'\\n\\n' ORDER BY turn, text) AS system FROM conversations WHERE turn % 5 = 0 GROUP BY 1)
SELECT m.conv_id, system, pos::INT AS pos, CASE WHEN turn % 5 = 3 THEN 'user' WHEN turn % 5 = 1 THEN 'assistant' ELSE role END AS role, text AS content,
CASE WHEN turn % 5 = 3 THEN 'tool_result' WHEN turn % 5 = 1 AND length(text) > 0 THEN 'text,tool_use' WHEN turn % 5 = 1 THEN 'tool_use' ELSE 'text' END AS blocks, CASE WHEN turn % 5 = 1 THEN '{"x":' || turn || '}' END AS input, CASE turn % 5 WHEN 1 THEN 'f' WHEN 3 THEN 'c' || conv_id END AS named FROM m LEFT JOIN sys USING (conv_id)""")
def message_translation(spark, sf):
    """Conversations as system, assistant turns with a tool call, and tool results among others."""
    kind = F.col("turn") % 5
    role = F.when(kind == 0, "system").when(kind == 3, "tool").when(kind == 1, "assistant").otherwise(F.col("role"))
    call = F.concat(F.lit('[{"id": "c", "function": {"name": "f", "arguments": "{\\"x\\":'), F.col("turn").cast("string"), F.lit('}"}}]'))
    turns = read_table(spark, sf, "conversations").withColumn("role", role).withColumn("tool_calls", F.when(kind == 1, call)).withColumn("tool_call_id", F.when(kind == 3, F.concat(F.lit("c"), F.col("conv_id").cast("string"))))
    rows = t.translated(turns).select("conv_id", "system", F.posexplode("messages").alias("pos", "m"))
    last = F.element_at("m.blocks", -1)
    return rows.select("conv_id", "system", "pos", "m.role", "m.content", F.array_join(F.transform("m.blocks", lambda b: b["type"]), ",").alias("blocks"), last["input"].alias("input"), F.coalesce(last["name"], F.when(last["type"] == "tool_result", last["id"])).alias("named"))


@query("""SELECT conv_id::VARCHAR AS trace_id, count(*) FILTER (turn % 4 <> 1) AS steps, coalesce(string_agg(CASE WHEN turn % 4 = 3 THEN text END, E'\\n' ORDER BY turn, text), '') AS response_text, 50 + sum(length(text)) AS total_tokens FROM conversations GROUP BY conv_id""")
def traces_from_blocks(spark, sf):
    """Hosted models' responses, given as content blocks, as traces."""
    rows = read_table(spark, sf, "conversations").groupBy("conv_id").agg(_blocks(), F.sum(F.length("text")).alias("output_tokens"))
    made = t.from_blocks(rows.select(F.col("conv_id").cast("string").alias("trace_id"), "blocks", F.lit(50).alias("input_tokens"), "output_tokens"))
    return made.select("trace_id", F.size("steps").cast("long").alias("steps"), "response_text", "total_tokens")


def traces(spark, sf):
    """A trace a document, judged by its label where it has one."""
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    rows = docs.join(labels.select("doc_id", F.col("quality").cast("boolean").alias("success")), "doc_id", "left").withColumn("segments", t.by_delimiter("text"))
    named = F.struct(F.lit("m").alias("name"), F.when(F.col("doc_id") % 3 == 0, "local").otherwise("anthropic").alias("backend"))
    task = F.struct(F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("task_id"))
    rows = rows.select("doc_id", F.col("doc_id").cast("string").alias("trace_id"), named.alias("model"), task.alias("task"), "segments", F.col("text").alias("response_text"), "success", F.lit(50).alias("input_tokens"), t.quarter(F.length("text")).alias("output_tokens"))
    return t.build_traces(rows)


@query("SELECT (SELECT count(*) FROM documents) AS total, count(*) FILTER (quality = 1) AS success, count(*) FILTER (quality = 0) AS failure, count(*) FILTER (quality IS NULL) AS unjudged, count(*) FILTER (d.doc_id % 3 = 0) AS local, count(*) FILTER (lang = 'en') AS en FROM documents d LEFT JOIN labels USING (doc_id)")
def trace_summary(spark, sf):
    return t.summary(traces(spark, sf)).select("total", "success", "failure", "unjudged", F.col("backends")["local"].alias("local"), F.col("datasets")["en"].alias("en"))


STEPS = r"""parts AS (SELECT doc_id, length(text) AS chars, unnest(string_split(text, E'\n')) AS raw, generate_subscripts(string_split(text, E'\n'), 1) AS k FROM documents),
ends AS (SELECT *, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS upto FROM parts),
own AS (SELECT doc_id, chars, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text, upto // 4 + 1 AS token_end, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS index, count(*) OVER (PARTITION BY doc_id) AS n FROM ends WHERE regexp_matches(raw, '\S')),
steps AS (SELECT doc_id, index, text, CASE WHEN index = n - 1 THEN 'output' ELSE 'thinking' END AS kind, token_end - lag(token_end, 1, 0) OVER (PARTITION BY doc_id ORDER BY index) AS token_count, 50 + chars // 4 + 1 AS total_tokens FROM own)"""


@query(f"WITH {STEPS} SELECT doc_id, index::INT AS index, text, kind, token_count::INT AS token_count, total_tokens::BIGINT AS total_tokens, (sum(token_count) FILTER (kind = 'thinking') OVER (PARTITION BY doc_id))::BIGINT AS thinking_tokens FROM steps")
def trace_build(spark, sf):
    rows = traces(spark, sf).select("doc_id", F.col("total_tokens").cast("long").alias("total_tokens"), F.nullif(F.col("thinking_tokens").cast("long"), F.lit(0)).alias("thinking_tokens"), F.explode("steps").alias("s"))
    return rows.select("doc_id", "s.index", "s.text", "s.kind", "s.token_count", "total_tokens", "thinking_tokens")


@query("SELECT doc_id, CASE WHEN n < 2 THEN 'fewer than 2 steps' ELSE 'kept' END AS state FROM (SELECT doc_id, len([x FOR x IN string_split(text, E'\\n') IF regexp_matches(x, '\\S')]) AS n FROM documents)")
def validate_traces(spark, sf):
    kept, refused = t.accepted(traces(spark, sf))
    return kept.select("doc_id", F.lit("kept").alias("state")).union(refused.select("doc_id", F.col("reason").alias("state")))


@query("SELECT doc_id::VARCHAR AS trace_id, CASE WHEN doc_id % 3 = 0 THEN 'local' ELSE 'anthropic' END AS backend, lang AS dataset, len([x FOR x IN string_split(text, E'\\n') IF regexp_matches(x, '\\S')]) AS steps, text AS response_text, quality = 1 AS success, doc_id IN (SELECT label FROM embeddings) AS has_tensors FROM documents LEFT JOIN labels USING (doc_id)")
def trace_store(spark, sf):
    """Traces written as JSON lines, some with states, and read again by schema; the second try replaces the first."""
    store = t.TraceStore(spark, shared_path(spark, "traces"))
    own = states(spark, sf).withColumn("trace_id", F.col("trace_id").cast("string"))
    for _ in range(2):
        store.append(traces(spark, sf).drop("doc_id"), own, batch="one")
    return store.read().select("trace_id", F.col("model.backend").alias("backend"), F.col("task.dataset").alias("dataset"), F.size("steps").cast("long").alias("steps"), "response_text", "success", "has_tensors")


@query(f"WITH {STATES_SQL} SELECT token_idx, j - 1 AS dim, round(state[j]::DOUBLE, 5) AS x FROM states, generate_series(1, 64) g(j) WHERE trace_id = 3")
def stored_states(spark, sf):
    """The states of one trace, looked up in a store of all."""
    store = t.TraceStore(spark, shared_path(spark, "traces"))
    own = states(spark, sf).withColumn("trace_id", F.col("trace_id").cast("string"))
    store.append(traces(spark, sf).drop("doc_id").where("trace_id in ('3', '4')"), own)
    return store.load("3").select("token_idx", F.posexplode("state").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("double"), 5))


SPANS = "spans AS (SELECT trace_id, k AS idx, n * k // 4 AS a, n * (k + 1) // 4 AS b FROM (SELECT trace_id, count(*) AS n FROM states GROUP BY 1), (VALUES (0), (1), (2), (3)) q(k))"


@query(f"WITH {STATES_SQL}, {SPANS} SELECT s.trace_id, idx, 0 AS layer, j - 1 AS dim, round(avg(state[j]), 4) + 0.0 AS x FROM spans s JOIN states t ON s.trace_id = t.trace_id AND token_idx >= a AND token_idx < b, generate_series(1, 64) g(j) GROUP BY ALL")
def pool_steps(spark, sf):
    st = states(spark, sf)
    quarters = F.explode(F.sequence(F.lit(0), F.lit(3)))
    spans = st.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).select("trace_id", "n", quarters.alias("idx")).select("trace_id", "idx", F.floor(F.col("n") * F.col("idx") / 4).cast("int").alias("token_start"), F.floor(F.col("n") * (F.col("idx") + 1) / 4).cast("int").alias("token_end"))
    return t.pool(spans, st).select("trace_id", "idx", "layer", F.posexplode("state").alias("dim", "x")).withColumn("x", F.round("x", 4) + 0.0)


@query(f"WITH {STATES_SQL} SELECT trace_id, token_idx - 4 AS token_idx, j - 1 AS dim, round(state[j]::DOUBLE, 5) AS x FROM states, generate_series(1, 64) g(j) WHERE token_idx >= 4 AND token_idx < 19")
def generated_slice(spark, sf):
    own = t.generated_states(states(spark, sf), F.lit(5), F.lit(20), -1, 1)
    return own.select("trace_id", "token_idx", F.posexplode("state").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("double"), 5))


def _pooled(spark, sf):
    """Four steps a trace, of two layers, the second one the first's double."""
    st = states(spark, sf)
    both = st.union(st.select("trace_id", "token_idx", F.lit(1), F.transform("state", lambda x: x * 2)))
    spans = st.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).select("trace_id", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx")).select("trace_id", "idx", F.floor(F.col("n") * F.col("idx") / 4).cast("int").alias("token_start"), F.floor(F.col("n") * (F.col("idx") + 1) / 4).cast("int").alias("token_end"))
    return t.pool(spans, both)


POOLED = "pooled AS (SELECT s.trace_id, idx, l.layer, j - 1 AS dim, avg(state[j] * (l.layer + 1)) AS x FROM spans s JOIN states t ON s.trace_id = t.trace_id AND token_idx >= a AND token_idx < b, generate_series(1, 64) g(j), (VALUES (0), (1)) l(layer) GROUP BY 1, 2, 3, 4)"


@query(f"WITH {STATES_SQL}, {SPANS}, {POOLED} SELECT trace_id, idx, dim, round(x, 4) + 0.0 AS x FROM pooled WHERE layer = 1")
def layer_select(spark, sf):
    """One of two captured layers, by the model's number of it."""
    own = t.layer_states(_pooled(spark, sf), [4, 11], 11)
    return own.select("trace_id", "idx", F.posexplode("state").alias("dim", "x")).withColumn("x", F.round("x", 4) + 0.0)


@query(f"WITH {STATES_SQL}, {SPANS}, {POOLED}, steps AS (SELECT DISTINCT trace_id, idx FROM pooled), placed AS (SELECT *, row_number() OVER (ORDER BY trace_id, idx) - 1 AS place FROM steps) SELECT place, trace_id, idx, dim, round(x, 4) + 0.0 AS x FROM pooled JOIN placed USING (trace_id, idx) WHERE layer = 0")
def concatenated_traces(spark, sf):
    rows = t.concatenated(_pooled(spark, sf), 0)
    return rows.select("place", "trace_id", "idx", F.posexplode("state").alias("dim", "x")).withColumn("x", F.round("x", 4) + 0.0)


ASSEMBLED = "said AS (SELECT trace_id, count(*) AS n FROM states GROUP BY 1), spans AS (SELECT trace_id, k AS idx, 2 * k AS a, 2 * k + 2 AS b FROM said, (VALUES (0), (1), (2)) q(k))"


@query(f"WITH {STATES_SQL}, {ASSEMBLED} SELECT s.trace_id, idx, j - 1 AS dim, round(avg(state[j]), 3) + 0.0 AS x FROM spans s JOIN states t ON s.trace_id = t.trace_id AND token_idx >= a AND token_idx < b, generate_series(1, 64) g(j) GROUP BY ALL")
def trace_assembly(spark, sf):
    """Segment, pool and build in one: three lines of seven characters a response, in half precision."""
    said = states(spark, sf).select("trace_id").distinct().select("trace_id", F.lit("abcdef.\nabcdef.\nabcdef.").alias("text"), F.lit(5).alias("input_tokens"), F.lit(6).alias("output_tokens"))
    made, pooled = t.assembled(said, states(spark, sf), half=True)
    rows = made.select("trace_id", F.explode("steps").alias("s")).select("trace_id", F.col("s.index").alias("idx")).join(pooled, ["trace_id", "idx"])
    return rows.select("trace_id", "idx", F.posexplode("state").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("double"), 3) + 0.0)


LAGGED = f"{STATES_SQL}, l AS (SELECT trace_id, token_idx, state AS c, lag(state) OVER w AS b, lag(state, 2) OVER w AS a FROM states WINDOW w AS (PARTITION BY trace_id ORDER BY token_idx))"
VELOCITY = f"{LAGGED}, v AS (SELECT trace_id, token_idx, list_cosine_distance(b, c) AS velocity FROM l WHERE b IS NOT NULL)"
CURVATURE = f"{LAGGED}, sides AS (SELECT trace_id, token_idx, list_distance(a, b) AS x, list_distance(b, c) AS y, list_distance(a, c) AS z FROM l WHERE a IS NOT NULL), k AS (SELECT trace_id, token_idx, 4 * sqrt(greatest((x+y+z)/2 * ((x+y+z)/2 - x) * ((x+y+z)/2 - y) * ((x+y+z)/2 - z), 0)) / (x * y * z) AS curvature FROM sides)"


@query(f"WITH {VELOCITY} SELECT trace_id, token_idx, round(velocity, 5) AS velocity FROM v")
def cosine_velocity(spark, sf):
    return g.velocity(states(spark, sf)).withColumn("velocity", F.round("velocity", 5))


@query(f"WITH {VELOCITY} SELECT trace_id, round(median(velocity), 5) AS median_velocity FROM v GROUP BY 1")
def velocity_median(spark, sf):
    return g.medians(g.velocity(states(spark, sf)), "velocity").withColumn("median_velocity", F.round("median_velocity", 5))


@query(f"WITH {CURVATURE} SELECT trace_id, token_idx, round(curvature, 5) AS curvature FROM k")
def menger_curvature(spark, sf):
    return g.curvature(states(spark, sf)).withColumn("curvature", F.round("curvature", 5))


@query(f"WITH {VELOCITY} SELECT round(avg(m), 5) AS mean_velocity, count(*) AS traces FROM (SELECT avg(velocity) AS m FROM v GROUP BY trace_id)")
def grouped_trajectory_mean(spark, sf):
    return g.mean_of_means(g.velocity(states(spark, sf)), "velocity").withColumn("mean_velocity", F.round("mean_velocity", 5))


def _measurements(spark, sf):
    o = read_table(spark, sf, "orders")
    names = F.explode(F.array(*map(F.lit, g.CORE))).alias("metric")
    rows = o.select(F.col("o_custkey").alias("trajectory_id"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("p"), names)
    value = F.when(F.col("step") % 17 == 0, F.lit(float("nan"))).when(F.col("metric").isin(*g.WHOLE), F.floor("p").cast("double")).otherwise(F.col("p"))
    m = g.measured(value, ~((F.col("step") % 19 == 0) & (F.col("metric") == "beta_1")))
    return rows.select("trajectory_id", "step", "metric", m.alias("m")).select("trajectory_id", "step", "metric", "m.*")


MEASURED = "m AS (SELECT o_custkey AS trajectory_id, o_orderkey AS step, metric, CASE WHEN o_orderkey % 19 = 0 AND metric = 'beta_1' THEN 'not_requested' WHEN o_orderkey % 17 = 0 THEN 'failed' ELSE 'measured' END AS status, CASE WHEN metric LIKE 'beta%' THEN floor(o_totalprice) ELSE o_totalprice END AS p FROM orders, (VALUES ('beta_0'), ('beta_1'), ('participation_ratio'), ('local_intrinsic_dim')) c(metric))"


@query(f"WITH {MEASURED} SELECT trajectory_id, step, metric, status, CASE WHEN status = 'measured' THEN round(p, 4) END AS value, CASE WHEN status = 'failed' THEN 'ValueError: Metric returned a non-finite value' END AS reason FROM m")
def measurement_status(spark, sf):
    return _measurements(spark, sf).withColumn("value", F.round("value", 4))


@query(f"WITH {MEASURED}, d AS (SELECT trajectory_id, step, metric, CASE WHEN status = 'measured' THEN p END - lag(CASE WHEN status = 'measured' THEN p END) OVER w AS delta, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY trajectory_id, metric ORDER BY step)) SELECT trajectory_id, step, metric, round(delta, 4) AS delta FROM d WHERE n > 1")
def step_deltas(spark, sf):
    return g.deltas(_measurements(spark, sf), strict=False).withColumn("delta", F.round("delta", 4))


@query(f"WITH {STATES_SQL}, x AS (SELECT trace_id, i, j, covar_samp(state[i], state[j]) AS c FROM states, generate_series(1, 64) a(i), generate_series(1, 64) b(j) GROUP BY 1, 2, 3) SELECT trace_id, round(power(sum(c) FILTER (i = j), 2) / sum(c * c), 4) AS participation_ratio FROM x GROUP BY 1")
def participation_ratio(spark, sf):
    return g.participation_ratio(states(spark, sf), "trace_id").withColumn("participation_ratio", F.round("participation_ratio", 4))


@query(f"WITH {STATES_SQL}, u AS (SELECT trace_id, [x / sqrt(list_inner_product(state, state)) FOR x IN state] AS s FROM states WHERE list_inner_product(state, state) > 0), m AS (SELECT trace_id, i, avg(s[i]) AS m FROM u, generate_series(1, 64) a(i) GROUP BY 1, 2) SELECT trace_id, round(sum(m * m), 5) AS anisotropy FROM m GROUP BY 1")
def anisotropy(spark, sf):
    return g.anisotropy(states(spark, sf), "trace_id").withColumn("anisotropy", F.round("anisotropy", 5))


def _points(spark, sf):
    return states(spark, sf).select(F.col("trace_id").alias("group"), F.col("token_idx").alias("id"), "state")


NEAR = STATES_SQL + ", near AS (SELECT a.trace_id AS grp, a.token_idx AS id, b.token_idx AS other, list_distance(a.state, b.state) AS d, row_number() OVER (PARTITION BY a.trace_id, a.token_idx ORDER BY list_distance(a.state, b.state), b.token_idx) AS rank FROM states a JOIN states b ON a.trace_id = b.trace_id AND a.token_idx <> b.token_idx)"


@query(f"WITH {NEAR}, p AS (SELECT grp, id, count(*) FILTER (rank < 5) / (count(*) FILTER (rank < 5) * ln(max(d) FILTER (rank = 5)) - sum(ln(d)) FILTER (rank < 5)) AS lid FROM near WHERE rank <= 5 GROUP BY 1, 2) SELECT grp AS \"group\", round(avg(lid), 4) AS local_intrinsic_dim FROM p GROUP BY 1")
def intrinsic_dimension(spark, sf):
    return g.intrinsic_dimension(_points(spark, sf), 5).withColumn("local_intrinsic_dim", F.round("local_intrinsic_dim", 4))


RANKED = "(SELECT a.trace_id AS grp, a.token_idx AS id, b.token_idx AS other, row_number() OVER (PARTITION BY a.trace_id, a.token_idx ORDER BY list_distance(a.state, b.state), b.token_idx) AS rank FROM {0} a JOIN {0} b ON a.trace_id = b.trace_id AND a.token_idx <> b.token_idx)"
LOST = "(SELECT grp, sum(x.rank - 5) AS lost FROM {} x JOIN {} y USING (grp, id, other) WHERE y.rank <= 5 AND x.rank > 5 GROUP BY 1)"


@query(f"WITH {STATES_SQL}, flat AS (SELECT trace_id, token_idx, state[1:3] AS state FROM states), far AS {RANKED.format('states')}, near AS {RANKED.format('flat')}, ns AS (SELECT trace_id AS grp, count(*) AS n FROM states GROUP BY 1), "
       f"t AS {LOST.format('far', 'near')}, c AS {LOST.format('near', 'far')} SELECT ns.grp AS \"group\", round(1 - 2.0 / (n * 5 * (2 * n - 16)) * coalesce(t.lost, 0), 5) AS trustworthiness, round(1 - 2.0 / (n * 5 * (2 * n - 16)) * coalesce(c.lost, 0), 5) AS continuity FROM ns LEFT JOIN t USING (grp) LEFT JOIN c USING (grp)")  # fmt: skip
def projection_quality(spark, sf):
    """How well the first three coordinates keep the neighbourhoods of all."""
    points = _points(spark, sf)
    rows = g.preserved(points, points.withColumn("state", F.slice("state", 1, 3)), 5)
    return rows.select("group", F.round("trustworthiness", 5).alias("trustworthiness"), F.round("continuity", 5).alias("continuity"))


@query()
def principal_components(spark, sf):
    return g.pca(_points(spark, sf), 2).select("group", "id", F.round(F.get("projected", F.lit(0)), 5).alias("x"), F.round(F.get("projected", F.lit(1)), 5).alias("y"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def timing_statistics(spark, sf):
    rows = g.timings(read_table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


PACKED = f"{MEASURED}, packed AS (SELECT trajectory_id, step, bool_and(status = 'measured') AS whole, max(status) FILTER (metric = 'beta_1') AS b1, max(status) FILTER (metric = 'beta_0') AS b0, list(p ORDER BY CASE metric WHEN 'beta_0' THEN 0 WHEN 'beta_1' THEN 1 WHEN 'participation_ratio' THEN 2 ELSE 3 END) AS ps FROM m GROUP BY 1, 2)"


@query(f"WITH {PACKED} SELECT trajectory_id, step, CASE WHEN whole THEN round(ps[1], 4) END AS beta_0, CASE WHEN whole THEN round(ps[3], 4) END AS participation_ratio, CASE WHEN b0 = 'failed' THEN 'metric beta_0 failed: ValueError: Metric returned a non-finite value' WHEN b1 = 'not_requested' THEN 'metric beta_1 was not requested' END AS reason, b1 AS beta_1_status FROM packed")
def measured_vectors(spark, sf):
    """Long measurements as vectors, through JSON and back; incomplete ones tell why they have no array."""
    packed = ms.vectors(_measurements(spark, sf), "trajectory_id", "step")
    back = packed.select("trajectory_id", "step", ms.vector_from_json(ms.vector_json(F.col("vector"))).alias("vector"))
    values = ms.to_array(F.col("vector"), strict=False)
    return back.select("trajectory_id", "step", F.round(F.get(values, F.lit(0)), 4).alias("beta_0"), F.round(F.get(values, F.lit(2)), 4).alias("participation_ratio"), ms.incomplete(F.col("vector")).alias("reason"), F.col("vector.measurements")["beta_1"]["status"].alias("beta_1_status"))


@query("WITH o AS (SELECT *, o_orderkey % 4 AS k FROM orders) SELECT o_orderkey, CASE k WHEN 1 THEN 'metric beta_0 has inconsistent numeric field and measurement' WHEN 2 THEN 'metric participation_ratio must have a finite measured value' END AS wrong, CASE WHEN k = 3 THEN 'metric beta_0 has unknown legacy provenance' END AS legacy FROM o")
def vector_consistency(spark, sf):
    """Vectors of numbers, a quarter each left alone, with another field, with a value that isn't finite, and without outcomes."""
    p, k = F.col("o_totalprice"), F.col("o_orderkey") % 4
    v = ms.of_numbers(F.array(F.floor(p).cast("double"), F.lit(1.0), p, p / 2))
    other = v.withField("beta_0", v["beta_0"] + 1)
    outcome = F.struct(F.lit("measured").alias("status"), F.lit(float("inf")).alias("value"), F.lit(None).cast("string").alias("reason"))
    broken = v.withField("measurements", F.transform_values(v["measurements"], lambda n, o: F.when(n == "participation_ratio", outcome).otherwise(o)))
    bare = v.withField("measurements", F.lit(None).cast(f"map<string, {ms.OUTCOME}>"))
    given = F.when(k == 1, other.cast(ms.VECTOR)).when(k == 2, broken.cast(ms.VECTOR)).when(k == 3, bare.cast(ms.VECTOR)).otherwise(v.cast(ms.VECTOR))
    rows = read_table(spark, sf, "orders").select("o_orderkey", k.alias("k"), ms.loaded(given).alias("v"))
    return rows.select("o_orderkey", ms.inconsistent(F.col("v")).alias("wrong"), F.when(F.col("k") == 3, ms.unavailable(F.col("v"), "beta_0")).alias("legacy"))


@query("WITH x AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS k, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey), d AS (SELECT c_custkey, k, floor(p) - lag(floor(p)) OVER w AS beta_0, p / 2 - lag(p / 2) OVER w AS lid FROM x WINDOW w AS (PARTITION BY c_custkey ORDER BY k)) SELECT c_custkey AS id, (k - 2)::INT AS pos, round(beta_0, 4) AS beta_0, round(lid, 4) AS lid, DATE '2024-01-02' AS day FROM d WHERE k > 1")
def trajectory_round_trip(spark, sf):
    """A trajectory a customer, through JSON and back, and its changes."""
    rows = read_table(spark, sf, "orders").join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", F.col("o_totalprice").alias("p"))
    listed = rows.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "p"))).alias("o"))
    made = F.transform("o", lambda o: ms.of_numbers(F.array(F.floor(o["p"]).cast("double"), F.lit(1.0), o["p"], o["p"] / 2)))
    whole = F.struct(F.col("c_custkey").cast("string").alias("id"), F.array(F.struct(F.lit("pca").alias("algorithm"), F.create_map(F.lit("k"), F.lit("2")).alias("params"))).alias("workflow"), F.lit("orders").alias("dataset_name"), made.alias("g_vectors"), F.lit("2024-01-02T03:04:05").alias("executed_at"), F.lit(1.5).alias("total_time_seconds"), F.array(F.lit(0.0), F.lit(1.5)).alias("per_step_times"), F.lit(None).cast("array<string>").alias("embedding_paths"))
    back = listed.select("c_custkey", ms.trajectory_from_json(ms.trajectory_json(whole.cast(ms.TRAJECTORY))).alias("t"))
    steps = back.select("c_custkey", ms.executed_at(F.col("t")).cast("date").alias("day"), F.posexplode(ms.vector_deltas(F.col("t"))).alias("pos", "d"))
    return steps.select(F.col("c_custkey").alias("id"), "pos", F.round("d.beta_0", 4).alias("beta_0"), F.round("d.local_intrinsic_dim", 4).alias("lid"), "day")


SPREAD = "(SELECT sum(v) FROM (SELECT var_samp(state[j]) AS v FROM {} , generate_series(1, 64) g(j) GROUP BY j))"


@query(f"WITH {STATES_SQL}, halved AS (SELECT trace_id, token_idx, [x / 2 FOR x IN state] AS state FROM states), few AS (SELECT * FROM halved WHERE token_idx < 10), all_of AS (SELECT 0 AS step, count(*) AS n, {SPREAD.format('states')} AS v FROM states UNION ALL SELECT 1, count(*), {SPREAD.format('halved')} FROM halved UNION ALL SELECT 2, count(*), {SPREAD.format('few')} FROM few) "
       "SELECT step::INT AS step, 'beta_0' AS metric, 'measured' AS status, n::DOUBLE AS value FROM all_of UNION ALL SELECT step, 'local_intrinsic_dim', 'measured', round(v, 3) FROM all_of UNION ALL SELECT step, 'beta_1', 'failed', NULL FROM all_of UNION ALL SELECT step, 'participation_ratio', 'not_requested', NULL FROM all_of")  # fmt: skip
def execute_sequence(spark, sf):
    """Three steps, raw, halved and cut, with one metric that fails while it runs and one that wasn't asked for."""
    one = lambda d: d.select(F.posexplode("state").alias("j", "x")).groupBy("j").agg(F.var_samp("x").alias("v"))
    metrics = {"beta_0": lambda d: d.agg(F.count(F.lit(1)).alias("value")), "local_intrinsic_dim": lambda d: one(d).agg(F.sum("v").alias("value")), "beta_1": lambda d: d.agg(F.sum(F.raise_error(F.lit("no loops here")).cast("double")).alias("value")), "participation_ratio": None}
    halved, few = (lambda d: d.withColumn("state", F.transform("state", lambda x: x / 2))), (lambda d: d.where("token_idx < 10"))
    raw = states(spark, sf).withColumn("state", F.col("state").cast("array<double>"))
    rows = g.trajectory(raw, [halved, few], metrics, ["beta_0", "beta_1", "local_intrinsic_dim"])
    return rows.select("step", "metric", "status", F.round("value", 3).alias("value"))


@query(f"WITH RECURSIVE {NEAR}, links AS (SELECT grp, id AS a, other AS b FROM near WHERE rank <= 2 UNION SELECT grp, other, id FROM near WHERE rank <= 2), reach AS (SELECT trace_id AS grp, token_idx AS a, token_idx AS b FROM states UNION SELECT r.grp, r.a, l.b FROM reach r JOIN links l ON l.grp = r.grp AND l.a = r.b) SELECT grp AS \"group\", count(DISTINCT low) AS connected_components FROM (SELECT grp, a, min(b) AS low FROM reach GROUP BY 1, 2) GROUP BY 1")
def connected_components(spark, sf):
    return g.connected_parts(_points(spark, sf), 2)
