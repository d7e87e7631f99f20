"""Conversations as rounds over a table: tools, errors, histories, resumption, and many at once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lumenfold.sources import dialogues
from lumenfold.sources.agents import Tool

ADD = Tool("add", "adds", lambda a, b: a + b)


def call(n, name, arguments):
    return {"id": str(n), "function": {"name": name, "arguments": arguments}}


def script(*turns):
    """A model that says its turns one after the other, by how many it has said since the last user's message."""

    def client():
        def say(shown):
            last = max(i for i, m in enumerate(shown) if m["role"] == "user")
            return turns[sum(m["role"] == "assistant" for m in shown[last:]) % len(turns)]

        return lambda batch: [say(shown) for shown in batch]

    return client


def prompts(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], "id string, prompt string, system string, history string")


def test_tools_and_histories(spark):
    calls = [call(1, "add", '{"a": 1, "b": 2}'), call(2, "no", None), call(3, "add", "{"), call(4, "add", '{"a": 1}'), call(5, "add", "[1]"), call(6, None, "{}")]
    client = script({"role": "assistant", "content": "Let me.", "tool_calls": calls}, {"content": "3"})
    done = dialogues.converse(prompts(spark, ("x", "1 + 2?", "Be brief.")), client, [ADD])
    one = done.first()
    messages = json.loads(one["messages"])
    told = [m["content"] for m in messages if m["role"] == "tool"]
    assert told[:2] == ["3", "Error: unknown tool 'no'"] and told[2].startswith("Error: could not parse arguments (") and told[3].startswith("Error: tool 'add' raised: ") and told[4].startswith("Error: tool 'add' raised: ") and told[5] == "Error: unknown tool None"
    assert (one["answer"], one["steps"], one["stopped"], len(json.loads(one["calls"])), one["error"]) == ("3", 2, "end_turn", 6, None)
    assert [m["role"] for m in messages] == ["system", "user", "assistant", *["tool"] * 6, "assistant"] and [m["tool_call_id"] for m in messages if m["role"] == "tool"] == list("123456")
    seen = [(r["kind"], r["name"], r["value"]) for r in dialogues.events(done).orderBy("place").collect()]
    assert seen[:5] == [("assistant", None, "Let me."), ("tool_call", "add", '{"a": 1, "b": 2}'), ("tool_result", "add", "3"), ("tool_call", "no", None), ("tool_result", "no", "Error: unknown tool 'no'")] and seen[-1] == ("assistant", None, "3") and len(seen) == 14
    rows = dialogues.transcripts(done)
    assert rows.count() == len(messages) and "add" in rows.where("turn = 2").first()["tool_calls"]
    # A history goes on with its own system text, and its calls aren't counted again.
    more = dialogues.converse(prompts(spark, ("x", "and now?", "Not again.", one["messages"])), script({"content": "done"}), [ADD]).first()
    assert [m["content"] for m in json.loads(more["messages"])][-2:] == ["and now?", "done"] and json.loads(more["messages"])[0]["content"] == "Be brief." and json.loads(more["calls"]) == []


def test_ends(spark):
    endless = dialogues.converse(prompts(spark, ("a", "go"), ("a", None), (None, "")), script({"content": None, "tool_calls": [call(1, "add", "")]}), [], max_steps=2).collect()
    assert len(endless) == 3 and {(r["stopped"], r["steps"], r["answer"]) for r in endless} == {("max_steps", 2, dialogues.NO_ANSWER)}
    silent = dialogues.converse(prompts(spark, ("a", "go")), script({"content": None, "tool_calls": []})).first()
    assert (silent["answer"], silent["stopped"]) == ("", "end_turn")
    assert dialogues.converse(prompts(spark).limit(0), script({"content": "x"})).collect() == []
    assert dialogues.converse(prompts(spark, ("a", "go")), script({"content": "x"}), max_steps=0).collect() == []


def test_a_failing_model_ends_its_own_conversation(spark):
    def client():
        def model(batch):
            if any(shown[0]["content"] == "bad" for shown in batch):
                raise RuntimeError("no")
            return [{"content": "fine"} if shown[0]["content"] != "odd" else "no message" for shown in batch]

        return model

    got = {r["id"]: (r["stopped"], r["answer"], r["error"]) for r in dialogues.converse(prompts(spark, ("a", "good"), ("b", "bad"), ("c", "odd")).coalesce(1), client, wait=0.0).collect()}
    assert got == {"a": ("end_turn", "fine", None), "b": ("failed", None, "RuntimeError: no"), "c": ("failed", None, "no message")}


def test_many_at_once_equal_one_by_one_and_resume(spark, tmp_path):
    asked, broken = str(tmp_path / "asked"), str(tmp_path / "broken")
    os.mkdir(asked)
    open(broken, "w").close()

    def client():
        def say(shown):
            n, turns = int(shown[0]["content"]), sum(m["role"] == "tool" for m in shown)
            open(f"{asked}/{n}-{turns}", "a").write("x")
            if turns < n % 4:
                return {"content": None, "tool_calls": [call(turns, "add", json.dumps({"a": n, "b": turns}))]}
            return {"content": " ".join(m["content"] for m in shown if m["role"] == "tool")}

        return lambda batch: [say(shown) for shown in batch]

    def slow(a, b):
        # Stands for a lost executor: the tool ends its task in the second round, until the file is gone.
        if b == 1 and a == 601 * 3 and os.path.exists(broken):
            raise SystemExit("lost")
        return a + b

    n = 1000
    rows = spark.range(n).select("id", (F.col("id") * 3).cast("string").alias("prompt")).repartition(3)
    tool = Tool("add", "adds", slow)
    with pytest.raises(Exception, match="lost"):
        dialogues.converse(rows, client, [tool], folder=str(tmp_path / "run")).count()
    before = {f: os.path.getsize(f"{asked}/{f}") for f in os.listdir(asked)}
    os.remove(broken)
    got = {r["id"]: (r["answer"], r["steps"], r["stopped"]) for r in dialogues.converse(rows, client, [tool], folder=str(tmp_path / "run")).collect()}
    assert got == {i: (" ".join(str(3 * i + t) for t in range(3 * i % 4)), 3 * i % 4 + 1, "end_turn") for i in range(n)}
    # What had been answered before the loss wasn't asked again.
    assert before and all(os.path.getsize(f"{asked}/{f}") == size for f, size in before.items())


def test_declarations():
    assert ADD.schema()["function"]["name"] == "add" and ADD.block()["input_schema"]["type"] == "object"
