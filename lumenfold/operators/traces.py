"""Reasoning traces: segmentation of responses, pooling of token states by span, assembly, storage and summary.

A token rule turns the length of a text prefix, in characters, into a number of tokens; the default counts a token for
every four characters and one more. `offset_rule` is that of a tokenizer whose tokens' ends are given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import let, pieces, running, strip

TokenRule = Callable[[Column], Column]
MODEL = "struct<name: string, backend: string, path: string, revision: string, generation_config: map<string,string>>"
TASK = "struct<dataset: string, task_id: string, prompt: string, expected_answer: string, domain: string, logic_type: string, metadata: map<string,string>>"
STEP = "struct<index: int, text: string, kind: string, token_count: int, has_hidden_states: boolean, layers_captured: array<int>>"
TRACE = (
    f"trace_id string, model {MODEL}, task {TASK}, steps array<{STEP}>, response_text string, success boolean, judge string, answer_extracted string, score double, "
    "input_tokens int, output_tokens int, thinking_tokens int, total_tokens int, timestamp string, duration_ms int, has_tensors boolean"
)
SEGMENT = "struct<text: string, token_start: int, token_end: int, kind: string>"
LARGEST_HALF = 65504.0


def quarter(characters: Column) -> Column:
    return (F.floor(characters / 4) + 1).cast("int")


def offset_rule(ends: str) -> TokenRule:
    """Tokens that end at or before a place, by the ascending ends of a text's tokens, found by halving."""

    def count(characters: Column) -> Column:
        size = F.size(F.col(ends))
        start = F.struct(F.lit(0).alias("low"), size.alias("high"))

        def halve(a: Column, _: Column) -> Column:
            middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
            before = F.get(F.col(ends), middle) <= characters
            halved = F.struct(F.when(before, middle + 1).otherwise(a["low"]).alias("low"), F.when(before, a["high"]).otherwise(middle).alias("high"))
            return F.when(a["low"] >= a["high"], a).otherwise(halved)

        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int")), start, halve, lambda a: a["low"])

    return count


def _steps(parts: Column, tokens: TokenRule) -> Column:
    """parts: array<struct<text, upto>>, upto in characters -> segments whose tokens follow each other."""
    ended = F.transform(parts, lambda p: F.struct(p["text"].alias("text"), tokens(p["upto"]).cast("int").alias("token_end"), p["kind"].alias("kind")))
    start = lambda bare, i: F.when(i == 0, F.lit(0)).otherwise(F.get(bare, i - 1)["token_end"])
    return let(ended, lambda bare: F.transform(bare, lambda s, i: F.struct(s["text"].alias("text"), start(bare, i).cast("int").alias("token_start"), s["token_end"].alias("token_end"), s["kind"].alias("kind"))))


def _placed(parts: Column, gap: int) -> Column:
    """array<struct<raw, upto>>: ends, in characters, of parts that lie `gap` characters apart."""
    ends = lambda all_of: running(F.transform(all_of, lambda p: (F.length(p) + gap).cast("bigint")))
    return let(parts, lambda all_of: F.zip_with(all_of, ends(all_of), lambda p, e: F.struct(p.alias("raw"), (e - gap).cast("int").alias("upto"))))


def by_delimiter(text: str, delimiter: str = "\n", tokens: TokenRule = quarter) -> Column:
    """Segments between literal delimiters; blank ones are skipped and the last is the output."""
    whole = F.col(text)
    found = F.filter(_placed(pieces(whole, delimiter), len(delimiter)), lambda p: strip(p["raw"]) != "")
    kind = lambda all_of, i: F.when(i == F.size(all_of) - 1, "output").otherwise("thinking")
    named = let(found, lambda all_of: F.transform(all_of, lambda p, i: F.struct(strip(p["raw"]).alias("text"), p["upto"].alias("upto"), kind(all_of, i).alias("kind"))))
    return _steps(named, tokens)


THINK = r"(?s)<think>(.*?)</think>"
SENTENCE = r"(?U)(?<=\.)\s+(?=[A-Z])"


def by_tags(text: str, tokens: TokenRule = quarter) -> Column:
    """Sentences inside the first think tags, and what comes after them as the output; without tags, all is output."""
    whole = F.col(text)
    inner, tagged = F.regexp_extract(whole, THINK, 1), whole.rlike(THINK)
    opening = F.instr(whole, "<think>") + 6
    closing = opening + F.length(inner) + 8
    # Sentences keep the blanks around them until their places are known.
    lines = _placed(F.split(inner, "\n", -1), 1)
    sentence = lambda line: F.transform(_sentences(line["raw"]), lambda s: F.struct(strip(s["raw"]).alias("text"), (opening + line["upto"] - F.length(line["raw"]) + s["upto"]).alias("upto")))
    thoughts = F.filter(F.flatten(F.transform(lines, sentence)), lambda p: p["text"] != "")
    after = strip(F.substring(whole, closing + 1, F.length(whole)))
    thinking = F.transform(thoughts, lambda p: F.struct(p["text"], p["upto"].cast("int").alias("upto"), F.lit("thinking").alias("kind")))
    out = F.struct(after.alias("text"), F.length(whole).alias("upto"), F.lit("output").alias("kind"))
    parts = F.when(after != "", F.concat(thinking, F.array(out))).otherwise(thinking)
    alone = F.array(F.struct(strip(whole).alias("text"), F.length(whole).alias("upto"), F.lit("output").alias("kind")))
    return _steps(F.when(~tagged | (F.size(parts) == 0), alone).otherwise(parts), tokens)


def _sentences(line: Column) -> Column:
    """array<struct<raw, upto>> of a line's sentences, upto before the blanks that follow."""
    found = F.struct(F.split(line, SENTENCE, -1).alias("parts"), F.regexp_extract_all(line, F.lit(SENTENCE), F.lit(0)).alias("blanks"))
    after = lambda f, i: F.coalesce(F.length(F.get(f["blanks"], i)), F.lit(0))
    ends = lambda f: running(F.transform(f["parts"], lambda p, i: (F.length(p) + after(f, i)).cast("bigint")))
    trailing = lambda p: F.length(p) - F.length(F.regexp_replace(p, r"(?U)\s+$", ""))
    placed = lambda f, all_ends: F.transform(f["parts"], lambda p, i: F.struct(p.alias("raw"), (F.get(all_ends, i) - after(f, i) - trailing(p)).cast("int").alias("upto")))
    return let(found, lambda f: let(ends(f), lambda all_ends: placed(f, all_ends)))


def _lowest_before(values: list[float]) -> list[float]:
    """Of each value the lowest one from it back to the last higher one, by a stack of falling values."""
    out, higher = [], []
    for value in values:
        low = value
        while higher and higher[-1][0] <= value:
            low = min(low, higher.pop()[1])
        higher.append((value, low))
        out.append(low)
    return out


def _tops(values: np.ndarray) -> np.ndarray:
    """Middles of the level stretches that are higher than what is on both sides."""
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    level = values[begin]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (begin[inner] + begin[inner + 1] - 1) // 2


def peaks(values: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Strict local maxima (middles of plateaus) that stand out by `prominence`, highest first where closer than `distance`.

    Linear but for one sort: what is kept lies apart, so a maximum is dropped by two others at most.
    """
    values = np.asarray(values, float)
    if len(values) < 3:
        return np.array([], int)
    tops = _tops(values)
    keep, at = np.ones(len(tops), bool), tops.tolist()
    for k in np.argsort(values[tops], kind="stable")[::-1].tolist() if distance > 1 else ():
        if keep[k]:
            for step, end in ((-1, -1), (1, len(at))):
                other = k + step
                while other != end and abs(at[other] - at[k]) < distance:
                    keep[other] = False
                    other += step
    listed = values.tolist()
    base = np.maximum(_lowest_before(listed), _lowest_before(listed[::-1])[::-1])
    tops = tops[keep]
    return tops[values[tops] - base[tops] >= prominence]


def velocity_segments(states: DataFrame, min_tokens: int = 5, factor: float = 1.0) -> DataFrame:
    """(trace_id, token_idx, state array) -> trace_id, idx, token_start, token_end, kind, cut where states jump.

    A trace's states are gathered in one group, whose size is that of one response.
    """

    def cut_trace(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("token_idx")
        x = np.stack(frame["state"].to_numpy()).astype(float)
        ends = [0, len(x)]
        if len(x) > 1:
            size = np.linalg.norm(x, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                speed = np.nan_to_num(1 - (x[1:] * x[:-1]).sum(1) / (size[1:] * size[:-1]))
            ends = sorted({0, len(x), *(int(p) + 1 for p in peaks(speed, float(np.median(speed)) * factor, min_tokens))})
        kinds = ["thinking"] * (len(ends) - 2) + ["output"]
        return pd.DataFrame({"trace_id": frame["trace_id"].iloc[0], "idx": range(len(ends) - 1), "token_start": ends[:-1], "token_end": ends[1:], "kind": kinds})

    kind = states.schema["trace_id"].dataType.simpleString()
    return states.select("trace_id", "token_idx", "state").groupBy("trace_id").applyInPandas(cut_trace, f"trace_id {kind}, idx int, token_start int, token_end int, kind string")


def hybrid_segments(texts: DataFrame, states: DataFrame, min_tokens: int = 5, factor: float = 1.0, tokens: TokenRule = quarter) -> DataFrame:
    """Tags outside and velocity inside: thinking tokens are cut where states jump, what follows the tags is one output.

    texts: trace_id, text. Without tags the whole response is cut by velocity; with fewer than two thinking tokens the
    tags alone decide.
    """
    marked = texts.withColumn("__tags", by_tags("text", tokens)).select("trace_id", "__tags", F.col("text").rlike(THINK).alias("__tagged"))
    first = F.filter("__tags", lambda s: s["kind"] == "thinking")
    bounds = marked.select("trace_id", "__tags", "__tagged", F.coalesce(F.array_max(F.transform(first, lambda s: s["token_end"])), F.lit(0)).alias("__until"))
    inside = states.join(bounds, "trace_id").where(~F.col("__tagged") | (F.col("token_idx") < F.col("__until")))
    moved = velocity_segments(inside.where(~F.col("__tagged") | (F.col("__until") >= 2)), min_tokens, factor).join(bounds, "trace_id")
    moved = moved.select("trace_id", "token_start", "token_end", F.when(F.col("__tagged"), "thinking").otherwise(F.col("kind")).alias("kind"))
    tags = bounds.where("__tagged").select("trace_id", "__until", F.explode("__tags").alias("s")).where((F.col("s.kind") == "output") | (F.col("__until") < 2))
    rows = moved.union(tags.select("trace_id", "s.token_start", "s.token_end", "s.kind"))
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("trace_id").orderBy("token_start")) - 1).select("trace_id", "idx", "token_start", "token_end", "kind")


def segment(df: DataFrame, how: str = "delimiter", text: str = "text", **options) -> DataFrame:
    """df with `segments`; velocity and hybrid need token states and have functions of their own."""
    if how == "delimiter":
        return df.withColumn("segments", by_delimiter(text, **options))
    if how == "tags":
        return df.withColumn("segments", by_tags(text, **options))
    if how in ("velocity", "hybrid"):
        raise ValueError(f"{how} segmentation needs token states: use {how}_segments")
    raise ValueError(f"unknown segmentation {how!r}; one of delimiter, tags, velocity, hybrid")


def pool(segments: DataFrame, states: DataFrame) -> DataFrame:
    """(trace_id, idx, token_start, token_end) and (trace_id, token_idx, layer, state) -> mean state by step and layer.

    An interval that is empty, reversed or outside the captured tokens is an error. Each step is spread over the numbers
    of its tokens, so tokens meet their steps by an equi-join on (trace_id, token_idx), and no token meets a step that
    it isn't in; vectors are averaged as such, and combined before the shuffle.
    """
    sizes = states.groupBy("trace_id").agg((F.max("token_idx") + 1).alias("n"))
    ok = (F.col("token_start") >= 0) & (F.col("token_start") < F.col("token_end")) & (F.col("token_end") <= F.coalesce("n", F.lit(0)))
    message = F.concat(F.lit("invalid pooling interval of step "), F.col("idx").cast("string"))
    checked = segments.join(sizes, "trace_id", "left").withColumn("token_start", F.when(ok, F.col("token_start")).otherwise(F.raise_error(message).cast("int")))
    spread = checked.select("trace_id", "idx", F.explode(F.sequence(F.col("token_start").cast("bigint"), F.col("token_end").cast("bigint") - 1)).alias("token_idx"))
    own = states.select("trace_id", F.col("token_idx").cast("bigint").alias("token_idx"), "layer", array_to_vector(F.transform("state", lambda x: x.cast("double"))).alias("v"))
    means = spread.join(own, ["trace_id", "token_idx"]).groupBy("trace_id", "idx", "layer").agg(Summarizer.mean(F.col("v")).alias("m"))
    return means.select("trace_id", "idx", "layer", vector_to_array("m").alias("state"))


def generated_states(states: DataFrame, input_length: Column, total: Column, layer: int, n_layers: int) -> DataFrame:
    """States that predict each generated token: position from input_length - 1 to total - 2, one layer, from the end if negative."""
    own = states.where((F.col("token_idx") >= input_length - 1) & (F.col("token_idx") < total - 1) & (F.col("layer") == layer % n_layers))
    return own.withColumn("token_idx", F.col("token_idx") - (input_length - 1))


def half_precision(state: Column) -> Column:
    """The state in single precision; an error where a 16-bit float would overflow."""
    fits = F.forall(state, lambda x: F.abs(x) <= LARGEST_HALF)
    return F.when(fits, state.cast("array<float>")).otherwise(F.raise_error(F.lit("a state has numbers beyond 16-bit floats")).cast("array<float>"))


def layer_states(pooled: DataFrame, captured: list[int], layer: int) -> DataFrame:
    """Pooled states whose `layer` counts captured layers -> those of one of the model's layers."""
    if layer not in captured:
        raise ValueError(f"layer {layer} was not captured; captured: {captured}")
    return pooled.where(F.col("layer") == captured.index(layer))


def concatenated(pooled: DataFrame, layer: int | None = None) -> DataFrame:
    """Pooled steps of many traces as one sequence: place (from 0), trace_id, idx, state, traces in order of their ids.

    Places are running counts of the traces before and the steps within, so no task sees all steps.
    """
    rows = pooled if layer is None else pooled.where(F.col("layer") == layer)
    sizes = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    # A row a trace is ordered by one task; the steps stay where they are.
    ahead = sizes.select("trace_id", F.coalesce(F.sum("n").over(Window.orderBy("trace_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("trace_id").orderBy("idx", "layer")) - 1
    return rows.withColumn("within", within).join(ahead, "trace_id").select((F.col("ahead") + F.col("within")).alias("place"), "trace_id", "idx", "state")


def assembled(responses: DataFrame, states: DataFrame, how: str = "delimiter", half: bool = False, tokens: TokenRule = quarter, min_tokens: int = 5, factor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Segment, pool and build: responses (trace_id, text, input_tokens, output_tokens; other columns are kept) and token
    states -> traces with steps, and states (trace_id, idx, layer, state) of the steps.

    Steps whose tokens weren't captured are cut to the captured ones; those without any have no state.
    """
    if how in ("delimiter", "tags"):
        rows = segment(responses, how, tokens=tokens)
    else:
        first = states.where(F.col("layer") == 0)
        cuts = velocity_segments(first, min_tokens, factor) if how == "velocity" else hybrid_segments(responses.select("trace_id", "text"), first, min_tokens, factor, tokens)
        listed = cuts.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("idx", "token_start", "token_end", "kind"))).alias("c"))
        own = F.transform("c", lambda c: F.struct(F.lit(None).cast("string").alias("text"), c["token_start"].alias("token_start"), c["token_end"].alias("token_end"), c["kind"].alias("kind")))
        rows = responses.join(listed, "trace_id", "left").withColumn("segments", F.coalesce(own, F.array().cast(f"array<{SEGMENT}>"))).drop("c")
    sizes = states.groupBy("trace_id").agg((F.max("token_idx") + 1).cast("int").alias("n"))
    spans = rows.select("trace_id", F.posexplode("segments").alias("idx", "s")).select("trace_id", "idx", "s.token_start", "s.token_end").join(sizes, "trace_id")
    inside = spans.withColumn("token_end", F.least("token_end", "n")).where("token_start < token_end").drop("n")
    pooled = pool(inside, states)
    return build_traces(rows), pooled.withColumn("state", half_precision(F.col("state"))) if half else pooled


def content_steps(blocks: Column) -> Column:
    """array<struct<type, text, thinking, name, input>> -> steps; other types are skipped and take no index."""
    known = F.filter(blocks, lambda b: b["type"].isin("thinking", "text", "tool_use"))
    kind = lambda b: F.when(b["type"] == "thinking", "thinking").when(b["type"] == "text", "output").otherwise("tool_call")
    call = lambda b: F.concat(F.lit('{"tool": '), _quoted(b["name"]), F.lit(', "input": '), b["input"], F.lit("}"))
    text = lambda b: F.when(b["type"] == "thinking", b["thinking"]).when(b["type"] == "text", b["text"]).otherwise(call(b))
    return F.transform(known, lambda b, i: F.struct(i.alias("index"), text(b).alias("text"), kind(b).alias("kind")))


def _quoted(c: Column) -> Column:
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def response_text(steps: Column) -> Column:
    return F.array_join(F.transform(F.filter(steps, lambda s: s["kind"] == "output"), lambda s: s["text"]), "\n")


CALLS = "array<struct<id: string, function: struct<name: string, arguments: string>>>"


def message_blocks(m: Column) -> Column:
    """array<struct<type, text, id, name, input, content>> of a message: a tool's answer as a result, an assistant's calls
    as uses of tools after its text, anything else as one text. Arguments that aren't a JSON object are an empty one."""
    block = lambda kind, **own: F.struct(F.lit(kind).alias("type"), *(own.get(k, F.lit(None).cast("string")).alias(k) for k in ("text", "id", "name", "input", "content")))
    calls = F.from_json(m["tool_calls"], CALLS)
    given = lambda c: F.when(F.from_json(c["function"]["arguments"], "map<string,string>").isNotNull() & F.try_parse_json(c["function"]["arguments"]).isNotNull(), c["function"]["arguments"]).otherwise(F.lit("{}"))
    uses = F.transform(calls, lambda c: block("tool_use", id=c["id"], name=c["function"]["name"], input=given(c)))
    said = F.when(F.coalesce(m["text"], F.lit("")) != "", F.array(block("text", text=m["text"]))).otherwise(F.array().cast("array<struct<type: string, text: string, id: string, name: string, input: string, content: string>>"))
    answered = F.array(block("tool_result", id=m["tool_call_id"], content=m["text"]))
    return F.when(m["role"] == "tool", answered).when((m["role"] == "assistant") & (F.size(calls) > 0), F.concat(said, uses)).otherwise(F.array(block("text", text=m["text"])))


def translated(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, and, if there are, tool_calls (JSON) and tool_call_id) -> conv_id, system (system
    turns, a blank line between), messages (role, content, blocks) in order.

    A conversation is one row afterwards, as it was one request before.
    """
    extra = [F.lit(None).cast("string").alias(c) for c in ("tool_calls", "tool_call_id") if c not in turns.columns]
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tool_calls", "tool_call_id")))
    rows = turns.select("*", *extra).groupBy("conv_id").agg(ordered.alias("t"))
    system = F.filter("t", lambda m: m["role"] == "system")
    role = lambda m: F.when(m["role"] == "tool", "user").otherwise(m["role"])
    messages = F.transform(F.filter("t", lambda m: m["role"] != "system"), lambda m: F.struct(role(m).alias("role"), m["text"].alias("content"), message_blocks(m).alias("blocks")))
    return rows.select("conv_id", F.when(F.size(system) > 0, F.array_join(F.transform(system, lambda m: m["text"]), "\n\n")).alias("system"), messages.alias("messages"))


def from_blocks(responses: DataFrame) -> DataFrame:
    """(trace_id, blocks, input_tokens, output_tokens; other columns are kept) -> steps, response_text, total_tokens."""
    steps = content_steps(F.col("blocks"))
    rows = responses.withColumn("steps", steps)
    return rows.withColumn("response_text", response_text(F.col("steps"))).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).drop("blocks")


def build_traces(responses: DataFrame) -> DataFrame:
    """responses with `segments`, input_tokens and output_tokens -> steps, thinking and total tokens."""
    last = F.size("segments") - 1
    kind = lambda s, i: F.coalesce(s["kind"], F.when(i == last, "output").otherwise("thinking"))
    steps = F.transform("segments", lambda s, i: F.struct(i.alias("index"), s["text"].alias("text"), kind(s, i).alias("kind"), (s["token_end"] - s["token_start"]).alias("token_count")))
    rows = responses.withColumn("steps", steps)
    thinking = F.aggregate(F.filter("steps", lambda s: s["kind"] == "thinking"), F.lit(0), lambda n, s: n + s["token_count"])
    return rows.withColumn("thinking_tokens", thinking).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).drop("segments")


def accepted(traces: DataFrame, least_steps: int = 2) -> tuple[DataFrame, DataFrame]:
    """-> (kept, rejected with a reason): text, steps and, where they are claimed, enough of them for velocities."""
    reason = F.when(F.coalesce(strip(F.col("response_text")), F.lit("")) == "", "empty response").when(F.coalesce(F.size("steps"), F.lit(0)) < least_steps, f"fewer than {least_steps} steps")
    checked = traces.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def summary(traces: DataFrame) -> DataFrame:
    """One row: total, success, failure, unjudged, and counts by backend and by dataset as maps.

    The traces are read once, for counts by outcome, backend and dataset; the rest comes from those few rows.
    """
    judged = F.when(F.col("success"), "success").when(~F.col("success"), "failure").otherwise("unjudged")
    counts = traces.groupBy(judged.alias("outcome"), F.col("model.backend").alias("backend"), F.col("task.dataset").alias("dataset")).count()
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("by"), F.col(c).alias("k")) for c in ("outcome", "backend", "dataset")))).alias("c")
    sums = counts.select("count", cells).groupBy("c.by", "c.k").agg(F.sum("count").alias("n"))
    of = lambda by: F.array_sort(F.collect_list(F.when((F.col("by") == by) & F.col("k").isNotNull(), F.struct("k", "n"))))
    outcome = lambda name: F.coalesce(F.sum(F.when((F.col("by") == "outcome") & (F.col("k") == name), F.col("n"))), F.lit(0)).alias(name)
    total = F.coalesce(F.sum(F.when(F.col("by") == "outcome", F.col("n"))), F.lit(0)).alias("total")
    return sums.agg(total, outcome("success"), outcome("failure"), outcome("unjudged"), F.map_from_entries(of("backend")).alias("backends"), F.map_from_entries(of("dataset")).alias("datasets"))


class TraceStore:
    """Traces as JSON lines in a folder, and their token states as Parquet beside them, tensors first.

    A batch of appended traces is a folder by its name, so an append that is tried again with the same name takes the
    place of what the first try left. States lie in BUCKETS folders by a hash of their trace, so a look-up reads one.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.traces_at, self.states_at = spark, f"{folder}/traces", f"{folder}/states"

    @classmethod
    def bucket(cls, trace_id: Column) -> Column:
        return F.pmod(F.crc32(trace_id.cast("string").cast("binary")), F.lit(cls.BUCKETS)).cast("int")

    def append(self, traces: DataFrame, states: DataFrame | None = None, batch: str | None = None) -> None:
        batch = batch or uuid.uuid4().hex
        if states is not None:
            states.withColumn("bucket", self.bucket(F.col("trace_id"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.states_at}/batch={batch}")
            has = states.select("trace_id").distinct().withColumn("__has", F.lit(True))
            traces = traces.join(has, "trace_id", "left").withColumn("has_tensors", F.coalesce("__has", F.lit(False))).drop("__has")
            traces = traces.withColumn("steps", F.transform("steps", lambda s: s.withField("has_hidden_states", F.col("has_tensors"))))
        traces.write.mode("overwrite").json(f"{self.traces_at}/batch={batch}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(TRACE).option("mode", "FAILFAST").json(self.traces_at).drop("batch")

    def states(self) -> DataFrame | None:
        """All states, or None where none was ever written."""
        try:
            return self.spark.read.parquet(self.states_at).drop("batch", "bucket")
        except AnalysisException:
            return None

    def load(self, trace_id) -> DataFrame | None:
        """The states of one trace, or None where it has none; other buckets are not read."""
        if self.states() is None:
            return None
        own = self.spark.read.parquet(self.states_at).where((F.col("bucket") == self.bucket(F.lit(trace_id))) & (F.col("trace_id") == trace_id)).drop("batch", "bucket")
        return None if own.isEmpty() else own

    def __len__(self) -> int:
        return self.read().count()

    def __iter__(self) -> Iterator:
        return self.read().toLocalIterator()
