import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import geometry as g
from lumenfold.operators import measurements as m
from lumenfold.operators import neighbours
from lumenfold.operators import traces as t


def segments(spark, text, how, **options):
    df = t.segment(spark.createDataFrame([(text,)], "text string"), how, **options)
    return [tuple(s) for s in df.first()["segments"]]


def test_delimiter(spark):
    assert [(s[0], s[3]) for s in segments(spark, "Step one\n\nStep two\nThe answer", "delimiter")] == [("Step one", "thinking"), ("Step two", "thinking"), ("The answer", "output")]
    assert segments(spark, "Just the answer", "delimiter") == [("Just the answer", 0, 4, "output")]
    assert segments(spark, "", "delimiter") == []
    with pytest.raises(ValueError):
        t.segment(None, "velocity")
    with pytest.raises(ValueError):
        t.segment(None, "other")


def test_tags(spark):
    each = {"tokens": lambda characters: characters}
    s = segments(spark, "x<think>Repeat. Repeat.\nRepeat.</think>Done.", "tags", **each)
    assert [x[0] for x in s] == ["Repeat."] * 3 + ["Done."] and [x[2] for x in s] == [15, 23, 31, 44] and [x[3] for x in s][-2:] == ["thinking", "output"]
    assert [x[3] for x in segments(spark, "<think>Just thinking here.</think>", "tags")] == ["thinking"]
    assert segments(spark, " plain ", "tags") == [("plain", 0, 2, "output")] and len(segments(spark, "<think> </think>", "tags")) == 1


def test_velocity(spark):
    rows = [("a", i, [1.0, 0.01 * (i % 2)] if i < 10 else [0.01 * (i % 2), 1.0]) for i in range(20)]
    cut = t.velocity_segments(spark.createDataFrame(rows, "trace_id string, token_idx int, state array<double>")).orderBy("idx").collect()
    assert 10 in [r["token_start"] for r in cut] and cut[-1]["kind"] == "output" and cut[-1]["token_end"] == 20
    assert list(t.peaks(np.array([0, 1, 0, 2, 2, 0, 3, 0.0]), 0.5, 1)) == [1, 3, 6]


def test_pool(spark):
    states = spark.createDataFrame([("a", i, 0, [float(i), 1.0]) for i in range(4)], "trace_id string, token_idx int, layer int, state array<double>")
    spans = spark.createDataFrame([("a", 0, 0, 2), ("a", 1, 2, 4)], "trace_id string, idx int, token_start int, token_end int")
    assert [r["state"] for r in t.pool(spans, states).orderBy("idx").collect()] == [[0.5, 1.0], [2.5, 1.0]]
    for a, b in ((1, 1), (2, 1), (-1, 2), (0, 5)):
        with pytest.raises(Exception, match="invalid pooling interval"):
            t.pool(spark.createDataFrame([("a", 0, a, b)], spans.schema), states).collect()


def test_store_and_summary(spark, tmp_path):
    rows = [(str(i), ("m", "local" if i else "anthropic", None, None, None), ("gsm8k", None, None, None, None, None, None), [(0, "a", "thinking", 1, False, None), (1, "b", "output", 1, False, None)], "b", [True, False, None][i]) for i in range(3)]
    df = spark.createDataFrame(rows, f"trace_id string, model {t.MODEL}, task {t.TASK}, steps array<{t.STEP}>, response_text string, success boolean")
    store = t.TraceStore(spark, str(tmp_path))
    store.append(df, spark.createDataFrame([("0", 0, 0, [1.0])], "trace_id string, token_idx int, layer int, state array<double>"))
    store.append(df.limit(1), batch="again")
    store.append(df.limit(1), batch="again")
    assert len(store) == 4 and len(list(store)) == 4 and store.states().count() == 1
    assert store.load("0").first()["state"] == [1.0] and store.load("9") is None and t.TraceStore(spark, str(tmp_path / "none")).load("0") is None
    assert {r["trace_id"]: r["has_tensors"] for r in store.read().where("has_tensors is not null").collect()} == {"0": True, "1": False, "2": False}
    s = t.summary(df).first()
    assert (s["total"], s["success"], s["failure"], s["unjudged"], s["backends"], s["datasets"]) == (3, 1, 1, 1, {"anthropic": 1, "local": 2}, {"gsm8k": 3})
    kept, refused = t.accepted(df.withColumn("steps", F.when(F.col("trace_id") == "0", F.slice("steps", 1, 1)).otherwise(F.col("steps"))))
    assert kept.count() == 2 and refused.first()["reason"] == "fewer than 2 steps"


def test_measurements(spark):
    df = spark.createDataFrame([(1.0, True), (float("nan"), True), (float("inf"), True), (0.0, True), (2.0, False)], "v double, asked boolean")
    got = [tuple(r["m"]) for r in df.select(g.measured(F.col("v"), F.col("asked")).alias("m")).collect()]
    assert got == [("measured", 1.0, None), ("failed", None, g.NON_FINITE), ("failed", None, g.NON_FINITE), ("measured", 0.0, None), ("not_requested", None, None)]
    rows = [("t", s, "beta_0", "measured", float(v)) for s, v in enumerate((10, 5, 1))]
    m = spark.createDataFrame(rows, "trajectory_id string, step int, metric string, status string, value double")
    assert [r["delta"] for r in g.deltas(m).orderBy("step").collect()] == [-5.0, -4.0]
    with pytest.raises(Exception, match="unavailable"):
        g.deltas(m.withColumn("status", F.lit("failed"))).collect()
    metrics = {
        "n": lambda d: d.agg(F.count(F.lit(1)).alias("value")), "bad": lambda d: d.select("no"), "late": lambda d: d.agg(F.sum(F.raise_error(F.lit("too late")).cast("int")).alias("value")), "off": None,
        "pair": lambda d: d.agg(F.array(F.lit(0.0), F.lit(9.0)).alias("pair")), "samples": lambda d: d.agg(F.array(F.lit(1.0), F.lit(3.0)).alias("samples")), "empty": lambda d: d.agg(F.array().cast("array<double>").alias("samples")),
        "beta_0": lambda d: d.agg(F.lit(2.9).alias("value")), "infinite": lambda d: d.agg(F.lit(float("inf")).alias("value")),
    }
    steps = g.trajectory(spark.range(4), [lambda d: d.limit(2)], metrics, [n for n in metrics if n != "off"])
    got = {(r["step"], r["metric"]): (r["status"], r["value"]) for r in steps.collect()}
    for s in (0, 1):
        assert [got[s, k] for k in ("n", "bad", "late", "off", "pair", "samples", "empty", "beta_0", "infinite")] == [("measured", 4.0 - 2 * s), ("failed", None), ("failed", None), ("not_requested", None), ("measured", 0.0), ("measured", 2.0), ("failed", None), ("measured", 2.0), ("failed", None)]
    assert "too late" in steps.where("metric = 'late'").first()["reason"] and steps.where("step = 0 and seconds <> 0").count() == 0


def test_geometry(spark):
    circle = [("c", i, [float(2 * np.cos(i)), float(2 * np.sin(i))]) for i in range(5)]
    df = spark.createDataFrame(circle, "trace_id string, token_idx int, state array<double>")
    assert all(abs(r["curvature"] - 0.5) < 1e-9 for r in g.curvature(df).collect()) and all(abs(r["velocity"] - (1 - np.cos(1))) < 1e-9 for r in g.velocity(df).collect())
    x = np.random.default_rng(0).normal(size=(30, 4)) * [3, 1, 1, 0.1]
    points = spark.createDataFrame([("g", i, list(map(float, v))) for i, v in enumerate(x)], "group string, id int, state array<double>")
    values = np.linalg.eigvalsh(np.cov(x.T))
    assert abs(g.participation_ratio(points, "group").first()[1] - values.sum() ** 2 / (values**2).sum()) < 1e-9
    flat = np.array([r["projected"] for r in g.pca(points, 4).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(flat[:, None] - flat[None], axis=2), np.linalg.norm(x[:, None] - x[None], axis=2))
    shadow = spark.createDataFrame([("g", i, list(map(float, v[:1]))) for i, v in enumerate(x)], points.schema)
    far, near = (np.linalg.norm(y[:, None] - y[None], axis=2) for y in (x, x[:, :1]))
    order = [np.argsort(np.argsort(d + np.diag([-1.0] * len(x)), axis=1, kind="stable"), axis=1) for d in (far, near)]
    want = [1 - 2 / (30 * 5 * (60 - 15 - 1)) * (a - 5)[(b <= 5) & (b > 0) & (a > 5)].sum() for a, b in (order, order[::-1])]
    got = g.preserved(points, shadow, 5).first()
    assert np.allclose([got["trustworthiness"], got["continuity"]], want)
    same = g.preserved(points, points, 5).first()
    assert (same["trustworthiness"], same["continuity"]) == (1.0, 1.0)


def test_vectors(spark):
    rows = [(1, "beta_0", "measured", 3.0, None), (1, "beta_1", "measured", 0.0, None), (1, "participation_ratio", "measured", 1.5, None), (1, "local_intrinsic_dim", "measured", 2.5, None), (2, "beta_0", "failed", None, "Boom: x"), (2, "extra", "measured", 7.0, None)]
    v = m.vectors(spark.createDataFrame(rows, "id int, metric string, status string, value double, reason string"), "id")
    got = {r["id"]: r for r in v.select("id", "vector", m.to_array(F.col("vector"), False).alias("a"), m.incomplete(F.col("vector")).alias("why"), m.unavailable(F.col("vector"), "beta_1").alias("b1")).collect()}
    assert got[1]["a"] == [3.0, 0.0, 1.5, 2.5] and got[1]["why"] is None and got[1]["vector"]["beta_0"] == 3
    assert got[2]["a"] is None and got[2]["why"] == "metric beta_0 failed: Boom: x" and got[2]["b1"] == "metric beta_1 was not requested" and got[2]["vector"]["beta_0"] == 0
    with pytest.raises(Exception, match="beta_0 failed"):
        v.select(m.to_array(F.col("vector"))).collect()
    back = v.select("vector", m.vector_from_json(m.vector_json(F.col("vector"))).alias("b")).collect()
    assert all(r["vector"] == r["b"] for r in back)
    bare = spark.createDataFrame([('{"beta_0": 1, "beta_1": 2, "participation_ratio": 0.5, "local_intrinsic_dim": 3.0}',), ('{"beta_0": 1, "beta_1": 2, "participation_ratio": 0.5, "local_intrinsic_dim": 3.0, "measurements": null}',)], "j string")
    for r in bare.select(m.vector_from_json(F.col("j")).alias("v"), m.incomplete(m.vector_from_json(F.col("j"))).alias("why")).collect():
        assert r["v"]["participation_ratio"] == 0.5 and r["v"]["measurements"]["beta_1"]["status"] == "unknown" and "unknown legacy" in r["why"]
    made = spark.createDataFrame([([1.0, 2.0, 0.5, 3.0],), ([1.0],)], "a array<double>")
    assert made.where(F.size("a") == 4).select(m.to_array(m.of_numbers(F.col("a"))).alias("a")).collect()[0]["a"] == [1.0, 2.0, 0.5, 3.0]
    with pytest.raises(Exception, match="expected 4"):
        made.select(m.of_numbers(F.col("a"))).collect()
    wrong = v.where("id = 1").select(F.col("vector").withField("beta_0", F.lit(4).cast("bigint")).alias("vector"))
    assert "inconsistent" in wrong.select(m.inconsistent(F.col("vector")).alias("w")).first()["w"]
    with pytest.raises(Exception, match="inconsistent"):
        m.all_consistent(wrong).collect()
    assert m.complete_only(v).count() == 1
    answers = spark.createDataFrame([(("measured", 2.0, None),), (("failed", 2.0, None),), ((None, None, [1.0, 3.0]),), (("measured", 4.0, [1.0]),)], "answer struct<status: string, scalar: double, per_sample: array<double>>")
    assert [r[0] for r in answers.select(m.scores()).collect()] == [2.0, None, 2.0, 4.0]


def test_trajectory_json(spark):
    v = '{"beta_0": %d, "beta_1": %d, "participation_ratio": %s, "local_intrinsic_dim": %s, "measurements": {"beta_0": {"status": "measured", "value": %d}, "beta_1": {"status": "measured", "value": %d}, "participation_ratio": {"status": "measured", "value": %s}, "local_intrinsic_dim": {"status": "measured", "value": %s}}}'
    numbers = [(10, 2, 0.1, 50.0), (5, 1, 0.3, 20.0), (1, 0, 0.6, 2.0)]
    whole = '{"id": "t", "workflow": [{"algorithm": "pca", "params": {"k": "3"}}], "dataset_name": "d", "g_vectors": [%s], "executed_at": "2024-05-06T07:08:09", "total_time_seconds": 1.5, "per_step_times": [0.0, 1.0, 0.5], "embedding_paths": null}' % ", ".join(v % (x * 2) for x in numbers)
    t1 = m.trajectory_from_json(F.col("j"))
    r = spark.createDataFrame([(whole,)], "j string").select(t1.alias("t"), m.vector_deltas(t1).alias("d"), m.executed_at(t1).cast("string").alias("at"), m.trajectory_from_json(m.trajectory_json(t1)).alias("again")).first()
    assert [x["beta_0"] for x in r["d"]] == [-5.0, -4.0] and [round(x["participation_ratio"], 6) for x in r["d"]] == [0.2, 0.3] and r["at"] == "2024-05-06 07:08:09" and r["t"] == r["again"]
    with pytest.raises(Exception, match="unknown legacy"):
        spark.createDataFrame([(whole.replace('"measurements"', '"other"'),)], "j string").select(m.vector_deltas(t1)).collect()


def test_outputs(spark):
    base = spark.createDataFrame([(1, [1.0], "a", 5)], "id int, embeddings array<double>, label string, free int")
    more = spark.createDataFrame([(1, [9.0], 0.5, 6)], "id int, embeddings array<double>, scores double, free int")
    r = m.merged_outputs(base, more, "id").first()
    assert (r["embeddings"], r["scores"], r["free"], r["label"]) == ([1.0], 0.5, 6, "a")
    assert m.geometric_features(m.merged_outputs(base, more, "id"), "id").columns == ["id", "embeddings", "geometric_metrics", "free"]
    for bad in (base.drop("embeddings"), base.withColumn("embeddings", F.lit(1))):
        with pytest.raises(ValueError):
            m.checked_outputs(bad)


def test_assembly(spark):
    states = spark.createDataFrame([("a", i, 0, [float(i), 1.0]) for i in range(5)] + [("b", 0, 0, [70000.0, 0.0])], "trace_id string, token_idx int, layer int, state array<double>")
    said = spark.createDataFrame([("a", "abcdef.\nabcdef.\nabcdef.", 5, 6), ("b", "x", 1, 1)], "trace_id string, text string, input_tokens int, output_tokens int")
    made, pooled = t.assembled(said, states.where("trace_id = 'a'"), half=True)
    assert [r["state"] for r in pooled.orderBy("idx").collect()] == [[0.5, 1.0], [2.5, 1.0], [4.0, 1.0]]
    assert {r["trace_id"]: (len(r["steps"]), r["total_tokens"]) for r in made.collect()} == {"a": (3, 11), "b": (1, 2)}
    with pytest.raises(Exception, match="16-bit"):
        t.assembled(said, states, half=True)[1].collect()
    assert t.assembled(said, states, "velocity", min_tokens=1)[0].where("trace_id = 'a'").first()["steps"][-1]["kind"] == "output"
    placed = t.concatenated(pooled.union(pooled.withColumn("trace_id", F.lit("c")))).orderBy("place").collect()
    assert [(r["place"], r["trace_id"], r["idx"]) for r in placed] == [(k, "ac"[k // 3], k % 3) for k in range(6)]
    assert t.layer_states(pooled, [7], 7).count() == 3
    with pytest.raises(ValueError, match="not captured"):
        t.layer_states(pooled, [7], 3)
    ends = spark.createDataFrame([([2, 5, 9],)], "ends array<int>")
    assert list(ends.select(*(t.offset_rule("ends")(F.lit(n)).alias(str(n)) for n in (0, 2, 4, 5, 8, 9, 20))).first()) == [0, 1, 1, 2, 2, 3, 3]


def test_messages(spark):
    rows = [
        (0, "system", "Be brief.", None, None), (1, "user", "Add.", None, None),
        (2, "assistant", "Let me see.", '[{"id": "1", "function": {"name": "add", "arguments": "{\\"a\\": 1}"}}, {"id": "2", "function": {"name": "add", "arguments": "{broken"}}]', None),
        (3, "tool", "3", None, "1"), (4, "system", "Now.", None, None), (5, "assistant", "", '[{"id": "3", "function": {"name": "end", "arguments": ""}}]', None), (6, "assistant", "Three.", None, None),
    ]
    r = t.translated(spark.createDataFrame([("c", *x) for x in rows], "conv_id string, turn int, role string, text string, tool_calls string, tool_call_id string")).first()
    assert r["system"] == "Be brief.\n\nNow." and [x["role"] for x in r["messages"]] == ["user", "assistant", "user", "assistant", "assistant"]
    blocks = [[(b["type"], b["text"] or b["name"] or b["content"], b["input"], b["id"]) for b in x["blocks"]] for x in r["messages"]]
    assert blocks[1] == [("text", "Let me see.", None, None), ("tool_use", "add", '{"a": 1}', "1"), ("tool_use", "add", "{}", "2")]
    assert blocks[2] == [("tool_result", "3", None, "1")] and blocks[3] == [("tool_use", "end", "{}", "3")] and blocks[4] == [("text", "Three.", None, None)]


def test_connected_parts(spark):
    points = [("g", i, [float(i + 100 * (i > 4)), 0.0]) for i in range(10)] + [("h", 0, [0.0, 0.0]), ("h", 1, [1.0, 0.0])]
    got = g.connected_parts(spark.createDataFrame(points, "group string, id int, state array<double>"), 2)
    assert {r["group"]: r["connected_components"] for r in got.collect()} == {"g": 2, "h": 1}


def test_peaks_are_linear_and_as_defined():
    def plain(v, least, apart):
        """By the definition: every maximum against all others."""
        n = len(v)
        runs = [(i, j) for i in range(1, n) for j in range(i, n - 1) if v[i - 1] < v[i] and all(v[k] == v[i] for k in range(i, j + 1)) and v[j + 1] < v[i]]
        tops = [(i + j) // 2 for i, j in runs]
        kept: list[int] = []
        for p in sorted(tops, key=lambda p: (v[p], p), reverse=True):
            if all(abs(p - q) >= apart for q in kept):
                kept.append(p)
        out = []
        for p in sorted(kept):
            left, right = [k for k in range(p) if v[k] > v[p]], [k for k in range(p + 1, n) if v[k] > v[p]]
            low = max(min(v[max(left, default=-1) + 1 : p + 1]), min(v[p : min(right, default=n)]))
            out += [p] * (v[p] - low >= least)
        return out

    rng = np.random.default_rng(6)
    for turn in range(300):
        n = int(rng.integers(0, 30))
        v = rng.integers(0, 5, n).astype(float) if turn % 2 else rng.random(n)
        for least, apart in ((0.0, 1), (1.0, 5), (2.5, 3), (0.3, 2)):
            assert t.peaks(v, least, apart).tolist() == plain(v.tolist(), least, apart)
    assert len(t.peaks(rng.random(400_000), 0.5, 5)) > 10_000


def test_centres_in_steps(spark, monkeypatch):
    """Centres go to the executors a bounded number at once, and no pair of blocks is lost for it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(96, 2)).round(3)
    points = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "g string, id long, v array<double>")
    monkeypatch.setattr(neighbours, "SENT_BYTES", 5_000, raising=False)
    sent = []
    monkeypatch.setattr(neighbours.F, "broadcast", lambda df, f=F.broadcast: {"c", "nc"} & set(df.columns) and sent.append(df.count()) or f(df))
    blocks = neighbours.Blocks(points, 2, 8, 8)
    near = {(r["id"], r["other"]) for r in blocks.nearest().collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(96, np.inf))
    assert near == {(i, int(j)) for i in range(96) for j in np.lexsort((np.arange(96), d[i]))[:2]}
    assert len(sent) > 2 and max(sent) * (8 * 2 + 200) < 1.5 * 5_000
