"""Archives of tensors as a data source, and loaders as a table function."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lumenfold.operators.tabular import merge
from lumenfold.sources import lateral, tensors


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    folder, rng, held = tmp_path_factory.mktemp("tensors"), np.random.default_rng(1), {}
    for n in range(4):
        held[f"t {n}"] = {"token_level": rng.random((5 + n, 2, 3)).astype(np.float16), "pooled_steps": rng.random((2, 3))} | ({"wide": rng.random((2, 2, 2, 2)).astype(np.float32), "none": np.zeros((0, 2, 3))} if n == 1 else {})
        np.savez_compressed(folder / f"t {n}.npz", **held[f"t {n}"])
    (folder / "notes.txt").write_text("x")
    return str(folder), held


def rows(held):
    out = []
    for trace, arrays in held.items():
        for name, x in arrays.items():
            x = x[:, None] if x.ndim == 2 else x.reshape(*x.shape[:2], int(np.prod(x.shape[2:])))
            out += [(trace, name, i, k, tuple(x[i, k].astype(np.float32).tolist())) for i in range(x.shape[0]) for k in range(x.shape[1])]
    return sorted(out)


def listed(df):
    return sorted((r["trace_id"], r["tensor"], r["token_idx"], r["layer"], tuple(r["state"])) for r in df.collect())


def test_archives(spark, archives):
    folder, held = archives
    tensors.register(spark)
    df = spark.read.format("trace_tensors").load(folder)
    assert listed(df) == rows(held) and df.rdd.getNumPartitions() == 4
    assert listed(tensors.load(spark, folder, ["t 1", "t 9"])) == rows({"t 1": held["t 1"]}) and tensors.load(spark, folder, ["t 1"]).rdd.getNumPartitions() == 1
    # A filter of one query doesn't reach the next one.
    assert df.where("trace_id = 't 2' AND tensor = 'pooled_steps'").count() == 2 and df.count() == len(rows(held))
    assert listed(tensors.by_spark(spark, folder)) == rows(held)
    assert tensors.load(spark, f"file://{folder.replace(' ', '%20')}", []).count() == 0 and tensors.load(spark, f"{folder}/none").count() == 0


def test_small_batches(monkeypatch, archives):
    folder, held = archives
    monkeypatch.setattr(tensors, "BATCH", 7)
    got = [b for b in tensors.batches("t 1", open(f"{folder}/t 1.npz", "rb").read())]
    assert max(b.num_rows for b in got) <= 2 and sum(b.num_rows for b in got) == len(rows({"t 1": held["t 1"]}))


def test_states_beside_traces(spark, archives):
    folder, held = archives
    traces = spark.createDataFrame([("t 0", "a"), ("t 3", "b"), ("gone", "c")], "trace_id string, layer_name string")
    got = tensors.with_states(traces, tensors.load(spark, folder)).collect()
    assert sum(r["trace_id"] == "t 0" for r in got) == 10 and sum(r["trace_id"] == "t 3" for r in got) == 16
    assert [(r["layer_name"], r["token_idx"], r["state"]) for r in got if r["trace_id"] == "gone"] == [("c", None, None)]


def test_archives_that_are_not_states(spark, tmp_path):
    np.savez(tmp_path / "x.npz", a=np.arange(3))
    with pytest.raises(Exception, match="isn't an array of floats"):
        tensors.load(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="give its path"):
        spark.read.format("trace_tensors").load().collect()


def test_archives_round_trip(spark, tmp_path, archives):
    folder, held = archives
    own = tensors.load(spark, folder).where("tensor = 'token_level'")
    for r in tensors.write_archives(own).collect():
        (tmp_path / f"{r['trace_id']}.npz").write_bytes(r["archive"])
    for name, arrays in held.items():
        with np.load(tmp_path / f"{name}.npz") as kept:
            assert (kept["token_level"] == arrays["token_level"]).all() and kept["token_level"].dtype == np.float16
    assert listed(tensors.load(spark, str(tmp_path))) == [r for r in rows(held) if r[1] == "token_level"]


@lateral.local_loader("test:frame")
def frame(n):
    return pd.DataFrame({"id": range(n), "text": "pandas", "more": 1})


@lateral.local_loader("test:parts")
def parts(n):
    yield pa.table({"id": list(range(n))})
    yield {"id": n, "text": "row"}
    yield pa.record_batch({"text": ["batch"]})


@lateral.local_loader("test:wrong")
def wrong():
    return "text"


def sources(spark, *given):
    return spark.createDataFrame([(name, loader, json.dumps(params)) for name, loader, params in given], "name string, loader string, params string")


def test_sources_by_lateral_join(spark, tmp_path):
    pd.DataFrame({"id": [7], "text": ["file"]}).to_parquet(tmp_path / "f.parquet")
    given = [("a", "test:frame", {"n": 2}), ("b", "test:parts", {"n": 1}), ("c", "files:dataset", {"path": str(tmp_path / "f.parquet")}), ("d", "values:rows", {"rows": []})]
    schema = "id long, text string"
    got = lateral.load_all(sources(spark, *given), schema, (__name__,))
    one = lambda name: spark.createDataFrame([(i, t) for i, t in {"a": [(0, "pandas"), (1, "pandas")], "b": [(0, None), (1, "row"), (None, "batch")], "c": [(7, "file")], "d": []}[name]], schema)
    want = merge([one(n) for n in "abcd"], "concat")
    assert got.drop("source").exceptAll(want).isEmpty() and want.exceptAll(got.drop("source")).isEmpty() and {r["source"] for r in got.collect()} == set("abc")
    sources(spark, *given).createOrReplaceTempView("given_sources")
    said = spark.sql("SELECT s.name, count(*) AS n, max(t.id) AS most FROM given_sources s, LATERAL load_rows(s.name, s.loader, s.params, 'id BIGINT, tags ARRAY<STRING>') t GROUP BY s.name").collect()
    assert {tuple(r) for r in said} == {("a", 2, 1), ("b", 3, 1), ("c", 1, 7)}


@pytest.mark.parametrize("loader, params, said", [("no:loader", {}, "source 'x': ValueError: no loader 'no:loader'"), ("test:wrong", {}, "source 'x': TypeError: a loader gives frames"), ("test:frame", {"m": 1}, "source 'x': TypeError")])
def test_errors_name_the_source(spark, loader, params, said):
    with pytest.raises(Exception, match=said):
        lateral.load_all(sources(spark, ("x", loader, params)), "id long", (__name__,)).collect()


def test_schemas():
    assert lateral.schema_of("a INT, `b` array<double>").simpleString() == "struct<a:int,b:array<double>>"
    assert lateral.schema_of(lateral.schema_of("a date").json()).simpleString() == "struct<a:date>"
    for bad in ("a", "a struct<x:int>"):
        with pytest.raises(ValueError):
            lateral.schema_of(bad)
    with pytest.raises(ValueError):
        lateral.local_loader("nocolon")
