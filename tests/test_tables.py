import json

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import tabular as t
from lumenfold.sources import agents, loaders, registry, sinks


def rows(df, *by):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_missing_keys(spark):
    left = spark.createDataFrame([(1, 1), (None, 2), (2, 3), (2, 4)], "id int, v int")
    right = spark.createDataFrame([(None, 9, "a"), (2, 8, "b"), (3, 7, "c")], "id int, v int, w string")
    inner = t.merge([left, right], "inner_join", "id")
    assert inner.columns == ["id", "v_x", "v_y", "w"] and rows(inner) == rows(spark.createDataFrame([(None, 2, 9, "a"), (2, 3, 8, "b"), (2, 4, 8, "b")], inner.schema))
    assert t.merge([left, right], "outer_join", ["id"]).count() == 5
    assert t.merge([left, right]).columns == ["id", "v", "w"] and t.merge([left, right], "other").count() == 7
    assert t.merge([left]).count() == 4 and t.merge([], spark=spark).count() == 0
    with pytest.raises(ValueError):
        t.merge([left, right], "outer_join")
    clash = t.concat([left.select("v"), spark.createDataFrame([("x",)], "v string")])
    assert dict(clash.dtypes)["v"] == "string" and clash.count() == 5


def test_filters_and_ranks(spark):
    df = spark.createDataFrame([(1, 1.0, "a.c"), (2, float("nan"), "abc"), (3, 3.0, None), (4, 2.0, "x"), (5, None, "y")], "id int, score double, s string")
    assert [r["id"] for r in t.rank_by(df, "score", True, tiebreak=["id"]).collect()] == [1, 4, 3, 2, 5]
    assert [r["id"] for r in t.rank_by(df, "score", tiebreak=["id"]).collect()] == [3, 4, 1, 2, 5]
    assert t.above(df, 0.0).count() == 3 and t.filter_by(df, "score", "greater_than", 1).count() == 2
    assert rows(t.filter_by(df, "s", "contains", "a.c").select("s")) == [("a.c",), ("abc",)]
    assert t.rank_by(df, "score", top=0).count() == 0
    for bad in (lambda: t.filter_by(df, "no", "equals", 1), lambda: t.filter_by(df, "id", "like", 1), lambda: t.score_and_rank(df, None), lambda: t.score_and_rank(df.drop("score"), lambda d: d)):
        with pytest.raises(ValueError):
            bad()


def test_validate(spark):
    df = spark.createDataFrame([(1, True, False), (2, False, False), (3, None, False), (4, None, True)], "id int, a_flag boolean, b_flag boolean")
    passed, flagged = t.validate(df, lambda d: d)
    assert [r[0] for r in rows(passed)] == [2, 3] and [r[0] for r in rows(flagged)] == [1, 4]
    kept, none = t.validate(df, lambda d: d, "flag")
    assert kept.count() == 4 and none.count() == 0
    for bad in (None, lambda d: d.select("id")):
        with pytest.raises(ValueError):
            t.validate(df, bad)


def test_simulated_scores_and_sources(spark, tmp_path):
    df = t.score_and_rank(spark.range(100), t.simulated_scores, 0.5, 2, key="id", seed=7)
    assert df.count() == 2 and all(r["score_simulated"] and r["score"] >= 0.5 for r in df.collect())
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert loaders.load_and_merge(spark, [{"loader": "tables:parquet", "params": {"path": str(tmp_path / "t")}}] * 2).count() == 6
    for name in ("tables", "tables:none", None):
        with pytest.raises(ValueError):
            loaders.load_source(spark, {"loader": name})
    assert [n for n, _ in loaders.variants("m", {"k": [1, 2], "p": 3})] == ["m__k_1", "m__k_2"]
    assert loaders.metric_spec({"a": {"k": 1}}) == ("a", {"k": 1}) and loaders.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and loaders.dotted({"a": {"b": 1}}) == {"a.b": 1}
    said = spark.createDataFrame([("p", "hello")], "prompt_id string, text string")
    good = agents.ask(said, "s", lambda: lambda texts: [x.upper() for x in texts]).first()
    assert good["success"] and good["raw_response"] == "HELLO"
    assert not agents.ask(said, "s", lambda: lambda texts: [" "], 1).first()["success"]


def test_asking(spark):
    """One prompt that fails leaves the others' answers; a refusal is asked once."""

    def client():
        calls = []

        def model(texts):
            calls.append(len(texts))
            if any("bad" in x for x in texts):
                raise RuntimeError("no")
            return [f"{x} {len(calls)}" for x in texts]

        return model

    rows = spark.createDataFrame([(str(i), "bad" if i == 2 else "good") for i in range(5)], "prompt_id string, text string").coalesce(1)
    got = {r["prompt_id"]: r for r in agents.ask(rows, "s", client, 2, 0.0).collect()}
    assert [got[str(i)]["success"] for i in range(5)] == [True, True, False, True, True] and got["2"]["error"] == "RuntimeError: no"

    def refusing():
        def model(texts):
            raise PermissionError("key")

        return model

    assert {r["error"] for r in agents.ask(rows, "s", refusing, 3, 100.0).collect()} == {"key"}


def test_paths(spark):
    """Functions by path, async loaders, and scores from embeddings that are joined by key."""

    @loaders.loader("own:later")
    async def later(spark, n):
        return spark.range(n)

    assert loaders.load_source(spark, {"loader": "own:later", "params": {"n": 4}}).count() == 4
    t.hook("own:dot")(lambda df, by=1.0: df.withColumn("score", F.col("vector")[0] * by))
    rows, vectors = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, s string"), spark.createDataFrame([(3, [5.0]), (1, [2.0])], "id int, vector array<double>")
    got = t.score_and_rank(rows, "own:dot", 1.0, embeddings=vectors, on="id", by=2.0)
    assert got.columns == ["id", "s", "score"] and [(r["id"], r["score"]) for r in got.collect()] == [(3, 10.0), (1, 4.0)]
    for bad in ("own", "own:none", "", None):
        with pytest.raises(ValueError):
            t.score_and_rank(rows, bad)
    t.hook("own:flags")(lambda df: df.withColumn("x_flag", F.col("id") > 1))
    assert t.validate(rows, "own:flags")[0].count() == 1 and t.transform(rows, "own:flags").columns[-1] == "x_flag"
    with pytest.raises(ValueError, match="filter_function"):
        t.validate(rows, "")


def test_mock(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(200)], "prompt_id int, text string")
    got = loaders.mock_results(rows, fail_rate=0.25).collect()
    assert 30 < sum(not r["success"] for r in got) < 70 and all((r["raw_response"] is None) == (not r["success"]) for r in got)
    assert {r["raw_response"] for r in loaders.mock_results(rows, response="Use PCA.").collect()} == {"Use PCA."}
    assert loaders.mock_results(rows, fail_rate=1.0).where("success").count() == 0


def test_settings():
    files = {
        "main": {"defaults": ["base", {"agent": "mock"}, "_self_"], "n": 3, "agent": {"delay": 0}}, "base": {"n": 1, "k": {"a": 1, "b": 2}}, "agent/mock": {"delay": 5, "methods": ["pca"]},
    }
    assert loaders.composed(files.__getitem__, "main", {"k": {"b": 7}}) == {"n": 3, "k": {"a": 1, "b": 7}, "agent": {"delay": 0, "methods": ["pca"]}}
    assert loaders.geometry_config({"data": "x", "algorithms": {}}) and loaders.geometry_config({"algorithms": {}}, True) and loaders.geometry_config({"pipeline": [1]})
    for bad in ({}, {"data": "x"}, {"algorithms": {}}, {"data": "x", "algorithms": [1]}):
        with pytest.raises(ValueError):
            loaders.geometry_config(bad)
    assert loaders.projected({"a": 1, "z": 2, "y": 3}, ["a", "b"]) == ({"a": 1}, ["y", "z"]) and loaders.task_config({}, "s") == {}
    with pytest.raises(ValueError):
        loaders.task_config([], "s")


def test_data(spark, tmp_path):
    assert loaders.load_vectors(spark, [[1, 2], [3, 4]]).orderBy("id").collect()[1]["state"] == [3.0, 4.0]
    assert loaders.load_vectors(spark, spark.createDataFrame([(1, [1.0], 2)], "id int, state array<double>, x int")).columns == ["id", "state"]
    with pytest.raises(ValueError):
        loaders.load_vectors(spark, "none")
    rows = spark.createDataFrame([(i, f"q{i}", f"so #### x #### {i} ") for i in (3, 1, 2)], "n int, question string, answer string")
    assert [(r["task_id"], r["prompt"], r["expected_answer"]) for r in loaders.tasks(rows, "n", 2).orderBy("task_id").collect()] == [("gsm8k_train_0", "q1", "1"), ("gsm8k_train_1", "q2", "2")]


FILES = {
    "metrics/lid.yaml": "lid:\n  _target_: x.Lid\n  _partial_: true\n  at: embedding\n  k: 10\n", "metrics/a_sweep.yaml": "lid:\n  _target_: x.Other\n  at: module\nspread:\n  _target_: x.Spread\n  at: dataset\n",
    "metrics/broken.yaml": "a: [", "metrics/test_x.yaml": "no:\n  _target_: x.No\n", "metrics/list.yaml": "defaults:\n  - lid\n", "metrics/module/graph.yaml": "graph:\n  _target_: x.Graph\n  n: [3, 5]\n", "metrics/bare.yaml": "bare:\n  k: 1\nplain:\n  _target_: x.Plain\n",
    "algorithms/latent/pca.yaml": "_target_: x.PCA\nn: 2\nseed: ${seed}\n", "ext/spread.yaml": "spread:\n  _target_: y.Spread\n  at: embedding\n",
}


def test_catalogue(spark, tmp_path):
    pytest.importorskip("yaml")
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    c = registry.Catalogue.scan(spark, str(tmp_path), [("ext", str(tmp_path / "ext"))], "1", str(tmp_path / "cache"))
    assert c.info("lid")["class"] == "x.Lid" and c.info("lid")["defaults"] == {"k": 10} and c.info("plain")["group"] == "embedding" and c.info("graph")["group"] == "module"
    assert registry.listed(spark, str(tmp_path / "ext")) == ["spread"]
    assert set(c.metrics) == {"lid", "spread", "graph", "plain"} and c.info("spread")["source"] == "ext" and c.names("module") == ["graph"] and c.counts() == {"group": {"embedding": 3, "dataset": 0, "module": 1}, "source": {"core": 3, "ext": 1}}
    assert c.algorithms == {"PCA": {"class": "x.PCA", "defaults": {"n": 2}, "source": "core", "source_file": "pca.yaml"}} and c.frame(spark).count() == 4
    with pytest.raises(KeyError):
        c.info("no")
    (tmp_path / "metrics/lid.yaml").unlink()
    assert "lid" in registry.Catalogue.scan(spark, str(tmp_path), version="1", cache=str(tmp_path / "cache")).metrics
    assert registry.Catalogue.scan(spark, str(tmp_path), version="2", cache=str(tmp_path / "cache")).info("lid")["class"] == "x.Other"
    registry.implements("x.Lid")(lambda d, k, scale=1.0: d.agg((F.count(F.lit(1)) * k * scale).alias("value")))
    registry.implements("x.Graph")(lambda d, n, scale=1.0: d.agg(F.raise_error(F.lit("late")).cast("double").alias("value")))
    ready = registry.set_up(c, [{"lid": {"k": [2, 3]}}, "graph"], scale=10.0)
    assert set(ready) == {"lid__k_2", "lid__k_3", "graph__n_3", "graph__n_5"} and ready["lid__k_3"]["params"] == {"k": 3, "scale": 10.0}
    got = {r["metric"]: (r["score"], r["error"]) for r in registry.execute(spark, ready, embedding=spark.range(4), module=spark.range(1)).collect()}
    assert got["lid__k_2"] == (80.0, None) and got["graph__n_3"][0] is None and "late" in got["graph__n_3"][1]
    assert registry.execute(spark, ready, dataset=spark.range(1)).count() == 0
    with pytest.raises(ImportError):
        registry.set_up(c, ["plain"])


def test_sinks(spark, tmp_path):
    prompts = spark.createDataFrame([("p", "g", ["umap"], ["leiden"])], "prompt_id string, expected_geometry string, ground_truth array<string>, failure array<string>")
    rows = [("a", "p", 0, True, ["umap"], False, "Use UMAP.\nNow."), ("b", "p", 0, False, None, None, None)]
    results = spark.createDataFrame(rows, "system string, prompt_id string, pos int, success boolean, extracted_methods array<string>, mentions_clustering boolean, raw_response string")
    m = sinks.save_results(results, prompts, str(tmp_path / "r"), "Name", "e7", "now")
    page = spark.read.text(str(tmp_path / "r/summary"), wholetext=True).first()["value"]
    assert page.startswith("# Name\n\n**Experiment ID:** e7\n**Timestamp:** now\n\n## Results\n\n| System") and "| a | n/a | 100.0% | 0.0% |" in page and "## Interpretation" in page
    assert sinks.read_results(spark, str(tmp_path / "r"), results.schema).count() == 2 and "a:\n  Jaccard Similarity: n/a" in sinks.printed(m).where("system = 'a'").first()["text"]
    place = sinks.save_artifact(results, str(tmp_path), "e7")
    assert place.endswith("responses_e7") and [tuple(r) for r in sinks.read_responses(spark, f"{place}/raw_responses").collect()] == [("a", "p", "Use UMAP.\nNow.")]
    (tmp_path / "t").mkdir()
    for name, text in (("a.txt", "hello\nyou"), ("b.txt", " \n"), ("c.txt", "")):
        (tmp_path / "t" / name).write_text(text)
    whole = {r["path"][-5:]: (r["raw_response"], r["valid"]) for r in sinks.read_whole(spark, str(tmp_path / "t")).collect()}
    assert whole["a.txt"] == ("hello\nyou", True) and not whole["b.txt"][1] and not whole.get("c.txt", (None, False))[1]
    numbers = spark.createDataFrame([("x", 1.0), ("y", None)], "metric string, value double")
    assert sinks.log_scalars(numbers, str(tmp_path / "log")).count() == 1 and spark.read.json(str(tmp_path / "log")).count() == 1 and sinks.log_scalars(numbers, None).count() == 1
    assert spark.read.parquet(sinks.save_embeddings(spark.range(3), str(tmp_path / "e"), 2)).count() == 3


def test_pushdown(spark, tmp_path):
    """Comparisons reach the scan; NaN on one side of a join meets null on the other."""
    spark.createDataFrame([(float(i), str(i)) for i in range(10)] + [(float("nan"), "n"), (None, None)], "x double, s string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for made, n in ((t.filter_by(df, "x", "greater_than", 5.0), 4), (t.filter_by(df, "x", "less_than", 5.0), 5), (t.filter_by(df, "s", "equals", "3"), 1), (t.above(df, 5.0, "x"), 5)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == n and any(f"{op}({c}," in plan for op in ("GreaterThan", "LessThan", "EqualTo", "GreaterThanOrEqual") for c in "xs")
    a, b = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "k double, a int"), spark.createDataFrame([(None, 7), (2.0, 8)], "k double, b int")
    assert sorted((r["a"], r["b"]) for r in t.merge([a, b], "inner_join", "k").collect()) == [(1, 7), (2, 8)]
    checked = spark.createDataFrame([(1, "s", None), (None, "s", None)], "success int, summary string, output_files map<string,string>")
    assert {r[0] for r in checked.select(t.contract_violation(checked)).collect()} == {"success is int"}
    assert {r[0] for r in checked.select(t.contract_violation(checked.drop("success"))).collect()} == {"missing success"}
    grid = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([[1.0], [2.0, 3.0]],), ([],), ([[float("nan")]],), (None,)], "m array<array<double>>")
    assert [r[0] for r in grid.select(t.finite_matrix("m")).collect()] == [True, False, False, False, False]
    passed, flagged = t.validate(spark.range(50).withColumn("a_flag", F.rand() < 0.5), lambda d: d.withColumn("b_flag", F.rand() < 0.5), once=True)
    assert passed.count() + flagged.count() == 50


def test_finite(spark):
    df = spark.createDataFrame([([1.0],), ([],), (None,), ([float("nan")],), ([float("inf")],)], "a array<double>")
    assert [r[0] for r in df.select(t.finite("a")).collect()] == [True, False, False, False, False]
    assert df.select(F.lit(1)).count() == 5
