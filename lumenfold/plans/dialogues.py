"""Conversations with tools, a prompt a row of the driver's table."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lumenfold.session import read_table
from lumenfold.sources import dialogues
from lumenfold.sources.agents import Tool

QUERIES, ORACLES = {}, {}


def scripted():
    """A model that counts a prompt's letters by a tool; at every third length it calls one that isn't there, too, and at
    every fifth it never stops."""

    def turn(shown: list[dict]) -> dict:
        prompt, told = shown[0].get("content", ""), [m for m in shown if m["role"] == "tool"]
        if told and len(prompt) % 5:
            return {"content": f"It has {told[0]['content']} letters."}
        call = lambda name: {"id": f"{name}-{len(told)}", "function": {"name": name, "arguments": json.dumps({"text": prompt})}}
        return {"content": None if told else "Let me count.", "tool_calls": [call("length")] + [call("weigh")] * (len(prompt) % 3 == 0 and len(prompt) % 5 > 0)}

    return lambda batch: [turn(shown) for shown in batch]


def tool_loop(spark, sf):
    """The first text of each conversation as a prompt, all in rounds."""
    prompts = read_table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", F.struct("turn", "text")).alias("prompt"))
    length = Tool("length", "letters of a text", lambda text: len(text), {"type": "object", "properties": {"text": {"type": "string"}}})
    out = dialogues.converse(prompts, scripted, [length], 3)
    told = dialogues.transcripts(out).groupBy("id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("text") == "Error: unknown tool 'weigh'").alias("unknown"))
    return out.drop("messages").join(told, "id").select("id", "answer", "steps", "stopped", "messages", "unknown", F.size(F.from_json("calls", dialogues.CALLS)).alias("calls"))


QUERIES["tool_loop"] = tool_loop
ORACLES["tool_loop"] = f"""WITH p AS (SELECT conv_id AS id, length(coalesce(arg_min(text, turn), '')) AS n FROM conversations GROUP BY 1), q AS (SELECT *, (n % 3 = 0)::INT AS odd FROM p)
SELECT id, CASE WHEN n % 5 = 0 THEN '{dialogues.NO_ANSWER}' ELSE 'It has ' || n || ' letters.' END AS answer, CASE WHEN n % 5 = 0 THEN 3 ELSE 2 END AS steps, CASE WHEN n % 5 = 0 THEN 'max_steps' ELSE 'end_turn' END AS stopped,
  CASE WHEN n % 5 = 0 THEN 7 ELSE 4 + odd END AS messages, CASE WHEN n % 5 = 0 THEN 0 ELSE odd END AS unknown, CASE WHEN n % 5 = 0 THEN 3 ELSE 1 + odd END AS calls FROM q"""
