"""Streams that catch up: durable totals, windows with late rows, intake of traces."""

import collections
import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from lumenfold.streaming import appended, intake

KEYED = "key string, other int"


def append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_counts_read_only_what_is_new(spark, tmp_path):
    path, folder = str(tmp_path / "store"), str(tmp_path / "own")
    told = collections.Counter()
    append(spark, [], KEYED, path)
    for rows in ([("a", 1), ("a", 2), (None, 3)], [("b", 1)], [], [("a", 1), (None, 1)]):
        append(spark, rows, KEYED, path)
        told.update(k for k, _ in rows)
        # Each call is one of its own, as after a restart, and finds its place by the folder alone.
        own = appended.Counts(spark, path, KEYED, ["key"], folder)
        assert own.catch_up() == len(rows) and own.catch_up() == 0
        assert dict(map(tuple, own.read().collect())) == told
    assert dict(map(tuple, appended.counts(spark, path, KEYED, ["key"]).collect())) == told
    assert appended.Counts(spark, path, KEYED, ["key"], str(tmp_path / "none")).read().collect() == []


def test_a_batch_that_is_tried_again_counts_once(spark, tmp_path):
    path, folder = str(tmp_path / "store"), str(tmp_path / "own")
    append(spark, [("a", 1)] * 3, KEYED, path)
    source, totals, seen = appended.stream(spark, path, KEYED), appended.Totals(spark, f"{folder}/totals", "key string, n long", ["key"]), []

    def work(df, batch):
        totals.add(df.groupBy("key").agg(F.count(F.lit(1)).alias("n")), batch)
        seen.append(batch)
        if len(seen) == 1:
            raise RuntimeError("lost after its counts were written")

    with pytest.raises(Exception, match="lost after"):
        appended.catch_up(source, folder, work)
    append(spark, [("b", 1)], KEYED, path)
    appended.catch_up(source, folder, work)
    assert seen[:2] == [0, 0] and dict(map(tuple, totals.read().collect())) == {"a": 3, "b": 1}


def test_totals_merge(spark, tmp_path):
    totals = appended.Totals(spark, str(tmp_path), "key string, n long, x double", ["key"])
    for batch in range(5):
        totals.add(spark.createDataFrame([("a", 1, 0.5), (None, 2, None)], totals.schema), batch)
    want = {("a", 5, 2.5), (None, 10, None)}
    assert set(map(tuple, totals.read().collect())) == want
    totals.merge(2)
    assert set(map(tuple, totals.read().collect())) == want and len(list((tmp_path / "apart").iterdir())) == 0
    # A merge that broke off leaves a folder without mark, which isn't read.
    (tmp_path / "merged" / "upto-9").mkdir()
    totals.add(spark.createDataFrame([("a", 1, 1.0)], totals.schema), 5)
    assert set(map(tuple, totals.read().collect())) == {("a", 6, 3.5), (None, 10, None)}


def test_closed_windows_drop_late_rows(spark, tmp_path):
    path, folder, schema = str(tmp_path / "store"), str(tmp_path / "own"), "ts timestamp, event_type string, value double"
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    append(spark, [(at(1, 0), "a", 1.0), (at(1, 59), "a", 2.0), (at(2, 30), "b", 1.0)], schema, path)
    source = appended.stream(spark, path, schema)
    first = appended.closed_windows(source, folder)
    assert [(r["start"].hour, r["event_type"], r["n"], r["total"]) for r in first.collect()] == [(1, "a", 2, 3.0)]
    # The mark stands at 02:20, so a row of 01:10 comes too late and one of 02:05 doesn't.
    append(spark, [(at(1, 10), "a", 9.0), (at(2, 5), "b", 5.0), (at(5, 0), "c", 1.0)], schema, path)
    second = appended.closed_windows(source, folder)
    assert sorted((r["start"].hour, r["event_type"], r["n"], r["total"]) for r in second.collect()) == [(1, "a", 2, 3.0), (2, "b", 2, 6.0)]


def record(task, success=True, summary=None, capture=False, steps=2, states=None, trace=None, judged=None):
    whole = {"trace_id": f"t{task}", "model": {"name": "m", "backend": "local"}, "task": {"dataset": "d"}, "steps": [{"index": i, "text": "x", "kind": "thinking"} for i in range(steps)], "response_text": "x", "success": judged}
    return task, success, summary, capture, json.dumps(whole) if trace is None else trace, states


STATE = [(0, 0, [1.0, 2.0]), (1, 0, [2.0, 1.0])]
RECORDS = [
    (record("a", states=STATE, judged=True), None), (record("b", judged=False), None), (record("c"), None), (record("d", steps=0), None), (record("e", False, "it broke"), "it broke"), (record("f", False), "failed without a summary"), (record("g", None, ""), "failed without a summary"),
    (record("h", trace=""), "no trace"), (record("i", trace='{"trace_id": "x"'), "a trace that can't be read"), (record("j", trace='{"trace_id": "x"}'), "a trace that can't be read"), (record("k", capture=True), "states asked for and not given"), (record("l", capture=True, states=[]), "states asked for and not given"),
    (record("m", states=[(0, 0, [math.nan])]), "states that aren't finite numbers"), (record("n", states=[(0, 0, [])]), "states that aren't finite numbers"), (record("o", states=[(0, 0, None)]), "states that aren't finite numbers"), (record("p", states=[(0, 0, [1.0, None])]), "states that aren't finite numbers"),
    (record("q", steps=1, states=STATE), "fewer than two steps"), (record("r", steps=0, states=STATE, capture=True), "fewer than two steps"), (record("s", states=STATE, capture=True, judged=True), None), ((None, True, None, None, None, None), "no trace"),
]


def test_intake(spark, tmp_path, monkeypatch):
    path, folder = str(tmp_path / "answers"), str(tmp_path / "own")
    rows = [r for r, _ in RECORDS]
    append(spark, rows[:9], intake.RECORD, path)
    own = intake.Intake(spark, path, folder)
    # The first try breaks off when its states and traces lie there and nothing is counted yet.
    whole = own.totals.add
    monkeypatch.setattr(own.totals, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("lost halfway")))
    with pytest.raises(Exception, match="lost halfway"):
        own.catch_up()
    monkeypatch.setattr(own.totals, "add", whole)
    append(spark, rows[9:], intake.RECORD, path)
    own.catch_up()
    assert intake.Intake(spark, path, folder).catch_up() == 0
    kept = [r for r, why in RECORDS if why is None]
    assert sorted(r["trace_id"] for r in own.store.read().collect()) == sorted(f"t{r[0]}" for r in kept)
    assert {r["trace_id"]: r["has_tensors"] for r in own.store.read().collect()} == {f"t{r[0]}": bool(r[5]) for r in kept}
    assert sorted(map(tuple, own.store.states().select("trace_id", "token_idx").collect())) == sorted((f"t{r[0]}", s[0]) for r in kept for s in r[5] or ())
    key = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, own.refused().collect()), key=key) == sorted(((r[0], why) for r, why in RECORDS if why), key=key)
    want = collections.Counter(("kept", "refused" if why else "kept") for _, why in RECORDS) + collections.Counter(("reason", why) for _, why in RECORDS if why)
    want += collections.Counter({("states", "with states"): 2, ("outcome", "success"): 2, ("outcome", "failure"): 1, ("outcome", "unjudged"): 2, ("backend", "local"): len(kept), ("dataset", "d"): len(kept)})
    assert {(r["by"], r["key"]): r["n"] for r in own.counts().collect()} == want
