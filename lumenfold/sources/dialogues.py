"""Conversations of models with tools, many at once, as rounds over a table.

A round gives every open conversation one turn: a model sees the transcripts of a batch and says the next message of
each; the calls of all those messages are a table of their own, which tools serve wherever its rows lie; their answers
go back to their conversations by a join. A conversation whose message calls nothing is done. So long conversations
hold up no others, one with many calls is spread out, and the driver sees a count a round.

Each round's messages are written before any tool is called, and its transcripts after, under the round's number in a
folder that the caller may name. A run that broke off goes on from the last round that was finished, and a model isn't
asked again what it has answered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.session import shared_path, ship
from lumenfold.sources.agents import Tool, each

CALLS = "array<struct<id: string, function: struct<name: string, arguments: string>>>"
MESSAGE = f"struct<role: string, content: string, tool_call_id: string, tool_calls: {CALLS}>"
#: Fixed value: the answer of a conversation that ran out of turns.
NO_ANSWER = "(stopped: reached max_steps without a final answer)"
Model = Callable[[list[list[dict]]], list[dict]]


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """A finished table, or None."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None


def _once(rows: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """The table at a path, made and written if it isn't there."""
    found = _written(spark, path)
    if found is None:
        rows().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast(CALLS).alias("tool_calls"))


def opened(prompts: DataFrame) -> DataFrame:
    """(id, prompt, and, if there are, system and history, the JSON of earlier messages) -> key, id, messages. A system
    text opens a conversation that has no history."""
    of = lambda name: F.col(name) if name in prompts.columns else F.lit(None).cast("string")
    before = F.coalesce(F.from_json(of("history"), f"array<{MESSAGE}>"), F.array().cast(f"array<{MESSAGE}>"))
    first = F.when((F.size(before) == 0) & (F.coalesce(of("system"), F.lit("")) != ""), F.array(_message("system", of("system")))).otherwise(before)
    messages = F.concat(first, F.array(_message("user", F.coalesce("prompt", F.lit("")))))
    return prompts.select(F.monotonically_increasing_id().alias("key"), "id", messages.cast(f"array<{MESSAGE}>").alias("messages"), F.size(before).alias("earlier"))


def said(open_: DataFrame, client: Callable[[], Model], attempts: int, wait: float) -> DataFrame:
    """key, message, error: the model's next message of each conversation."""

    def turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for frame in frames:
            if len(frame):
                shown = [[{k: v for k, v in m.items() if v is not None} for m in json.loads(x)] for x in frame["messages"]]
                pairs = each(model, shown, attempts, wait)
                whole = [isinstance(m, dict) for m, _ in pairs]
                yield pd.DataFrame({
                    "key": frame["key"], "message": [json.dumps({"role": "assistant"} | m) if ok else None for (m, _), ok in zip(pairs, whole, strict=True)],
                    "error": [None if ok else wrong or "no message" for (_, wrong), ok in zip(pairs, whole, strict=True)],
                })

    shown = open_.select("key", F.to_json("messages").alias("messages"))
    return shown.mapInPandas(turns, "key long, message string, error string").select("key", F.from_json("message", MESSAGE).alias("message"), "error")


def parsed(arguments: str | None) -> tuple[dict | None, str]:
    """A call's arguments, or None and what is wrong with them."""
    try:
        return json.loads(arguments or "{}"), ""
    except json.JSONDecodeError as wrong:
        return None, str(wrong)


def served(calls: DataFrame, tools: Sequence[Tool]) -> DataFrame:
    """(key, place, call, name, arguments) -> key, place, call, answer. What goes wrong is the answer, in fixed words."""
    known = {t.name: t.run for t in tools}

    def outcome(run: Callable[..., object], name: str, arguments: str | None) -> str:
        given, wrong = parsed(arguments)
        if given is None:
            return f"Error: could not parse arguments ({wrong})"
        try:
            return str(run(**given))
        except Exception as failed:  # noqa: BLE001 - the model hears of it
            return f"Error: tool {name!r} raised: {failed}"

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, own in frame.groupby("name", dropna=False, sort=False):
                name = None if pd.isna(name) else name
                given = [None if pd.isna(a) else a for a in own["arguments"]]
                told = [outcome(known[name], name, a) for a in given] if name in known else f"Error: unknown tool {name!r}"
                yield own[["key", "place", "call"]].assign(answer=told)

    return calls.mapInPandas(answers, "key long, place int, call string, answer string")


def converse(prompts: DataFrame, client: Callable[[], Model], tools: Sequence[Tool] = (), max_steps: int = 8, folder: str | None = None, attempts: int = 1, wait: float = 1.0) -> DataFrame:
    """id, answer, messages (JSON), steps, stopped (end_turn, max_steps or failed), calls (JSON of those made), error.

    prompts: as `opened` takes them. `client` makes, on each worker, the function that takes transcripts and gives the
    next message of each, as chat models do: role, content and tool_calls. Conversations are rows, whatever their ids;
    `messages` is the `history` that a later call goes on from. A model that fails ends its conversation alone.
    """
    spark = prompts.sparkSession
    ship(spark)
    folder = (folder or shared_path(spark, "dialogues")).rstrip("/")
    now, done = _once(lambda: opened(prompts), spark, f"{folder}/open-0"), []
    for step in range(1, max_steps + 1):
        if now.isEmpty():
            break
        before = now
        message = _once(lambda: said(before, client, attempts, wait), spark, f"{folder}/said-{step}")  # noqa: B023 - called at once
        calls = message.select("key", F.posexplode("message.tool_calls").alias("place", "c")).select("key", "place", F.col("c.id").alias("call"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))
        told = F.struct(F.lit("tool").alias("role"), F.col("answer").alias("content"), F.col("call").alias("tool_call_id"), F.lit(None).cast(CALLS).alias("tool_calls"))
        heard = served(calls, tools).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", told.alias("m")))), lambda x: x["m"]).alias("heard"))
        kept = F.concat("messages", F.when(F.col("message").isNotNull(), F.array("message")).otherwise(F.array().cast(f"array<{MESSAGE}>")), F.coalesce("heard", F.array().cast(f"array<{MESSAGE}>")))
        stopped = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce(F.size("message.tool_calls"), F.lit(0)) <= 0, "end_turn")
        if step == max_steps:
            stopped = F.coalesce(stopped, F.lit("max_steps"))
        answer = F.when(stopped == "end_turn", F.coalesce("message.content", F.lit(""))).when(stopped == "max_steps", NO_ANSWER)
        rows = before.join(message, "key").join(heard, "key", "left").select("key", "id", kept.alias("messages"), "earlier", stopped.alias("stopped"), answer.alias("answer"), "error")
        after = _once(lambda: rows, spark, f"{folder}/after-{step}")  # noqa: B023 - called at once
        done.append(after.where("stopped IS NOT NULL").withColumn("steps", F.lit(step)))
        now = after.where("stopped IS NULL").select("key", "id", "messages", "earlier")
    out = done[0] if done else _none(now)
    for more in done[1:]:
        out = out.unionByName(more)
    new = F.slice("messages", F.col("earlier") + 1, F.size("messages"))
    made = F.flatten(F.transform(F.filter(new, lambda m: m["tool_calls"].isNotNull()), lambda m: m["tool_calls"]))
    return out.select("id", "answer", F.to_json("messages").alias("messages"), "steps", "stopped", F.to_json(made).alias("calls"), "error")


def _none(open_: DataFrame) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    return open_.limit(0).withColumns({"stopped": null("string"), "answer": null("string"), "error": null("string"), "steps": null("int")})


def transcripts(outcomes: DataFrame) -> DataFrame:
    """Rows (id, messages: JSON) of many conversations -> id, turn, role, text, tool_calls, tool_call_id, as `traces.translated` takes them."""
    rows = outcomes.select("id", F.posexplode(F.from_json("messages", f"array<{MESSAGE}>")).alias("turn", "m"))
    return rows.select("id", "turn", "m.role", F.col("m.content").alias("text"), F.to_json("m.tool_calls").alias("tool_calls"), "m.tool_call_id")


def events(outcomes: DataFrame) -> DataFrame:
    """id, place, kind (assistant, tool_call, tool_result), name, value: what a watcher of the conversations sees, in order;
    a call's value is its arguments, and each result stands after its call."""
    rows = outcomes.select("id", F.posexplode(F.from_json("messages", f"array<{MESSAGE}>")).alias("turn", "m"), F.from_json("messages", f"array<{MESSAGE}>").alias("all"))
    event = lambda place, kind, name, value: F.struct(place.alias("place"), F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))
    none, at = F.lit(None).cast("string"), F.col("turn").cast("long") * 1_000_000
    spoken = F.when(F.coalesce("m.content", F.lit("")) != "", F.array(event(at, "assistant", none, F.col("m.content")))).otherwise(F.array().cast("array<struct<place: long, kind: string, name: string, value: string>>"))
    result = lambda i: F.get("all", F.col("turn") + 1 + i)["content"]
    pair = lambda c, i: F.array(event(at + 2 * i + 1, "tool_call", c["function"]["name"], c["function"]["arguments"]), event(at + 2 * i + 2, "tool_result", c["function"]["name"], result(i)))
    both = F.concat(spoken, F.coalesce(F.flatten(F.transform("m.tool_calls", pair)), F.array().cast("array<struct<place: long, kind: string, name: string, value: string>>")))
    return rows.where("m.role = 'assistant'").select("id", F.inline(both))
