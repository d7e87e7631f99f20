"""Benchmark decontamination: one Aho-Corasick automaton over the test items' windows, one scan of each text.

Normalising lower-cases A-Z and splits at what aren't word characters. The automaton's symbols are words: each word of
the items has a number, so a window is a path of at most 13 nodes and a hit's place is the number of a word, which
gives the offsets in the original text. It scans the runs of such words; other words end them.

An automaton has NODES nodes at most, however long the items' words are, which bounds a worker's memory (some 0.1 kB a
node). More items than that are scanned for in several passes over the documents, one automaton each, and the hits are
joined row by row.

A null or empty text has no words and no hits; a null or empty item has no windows. Items with one item_id count
once; an item without item_id hits words and isn't listed. A text of any length is scanned whole. Rows are scanned one
by one, so equal rows don't matter, and other columns' names clash with nothing. Without documents there are no rows,
without items no hits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.held import held
from lumenfold.session import read_table, ship

WINDOW = 13
#: Nodes of an automaton at most; one item alone may have more.
NODES = 2_500_000
#: The contract's word characters.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
HITS = "array<struct<item: long, first: int, last: int>>"
RESULT = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<item_id: long, start: int, end: int>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


class Automaton:
    """Of (item_id, normalised text); a pattern's value is its number of words and the items that have it."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        have: dict[tuple[int, ...], set[int | None]] = defaultdict(set)
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split()]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                have[tuple(own[i : i + window])].add(item)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in have.items():
            self.tree.add_word(key, (len(key), tuple(sorted(found, key=lambda x: (x is None, x)))))
        self.tree.make_automaton()
        # Runs of the items' words, of the shortest window's length at least: nothing else can have a hit.
        self.runs = re.compile(b"\x01{%d,}" % min(map(len, have))).finditer if have else None

    def find(self, own: list[bytes]) -> list[tuple[int | None, int, int]]:
        """(item, first word, last word) of the runs of words that an item's windows cover."""
        if not own or not self.runs:
            return []
        number, found = self.numbers.__getitem__, []
        for run in self.runs(bytes(map(self.numbers.__contains__, own))):
            at = run.start()
            found += [(at + end - n + 1, at + end, items) for end, (n, items) in self.tree.iter(tuple(map(number, own[at : run.end()])))]
        runs: dict[int | None, list[list[int]]] = defaultdict(list)
        for first, last, items in sorted(found, key=lambda x: x[0]):
            for item in items:
                if runs[item] and first <= runs[item][-1][1] + 1:
                    runs[item][-1][1] = max(runs[item][-1][1], last)
                else:
                    runs[item].append([first, last])
        return [(item, a, b) for item in runs for a, b in runs[item]]


def _scanner(items, window: int, last: bool, whole: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = items.value
        tree = held(("automaton", window, hash(tuple(given))), lambda: Automaton(given, window))
        for batch in batches:
            hits, n_words, n_hit, listed, spans = [], [], [], [], []
            earlier = batch.column(2).to_pylist()
            for k, text in enumerate(batch.column(1).field("text") if whole else batch.column(1)):
                text = text.as_py()
                own = words(text)
                found = [(h["item"], h["first"], h["last"]) for h in earlier[k]] + tree.find(own)
                if not last:
                    hits.append([{"item": i, "first": a, "last": b} for i, a, b in found])
                    continue
                n_words.append(len(own))
                covered = np.zeros(len(own) if found else 0, bool)
                for _, a, b in found:
                    covered[a : b + 1] = True
                n_hit.append(int(covered.sum()))
                listed.append(sorted({i for i, _, _ in found if i is not None}))
                at = [m.span() for m in WORD.finditer(text.translate(ASCII_LOWER))] if found else []
                spans.append([{"item_id": i, "start": at[a][0], "end": at[b][1]} for i, a, b in found])
            if last:
                kinds = [pa.list_(pa.int64()), pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))]
                columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(listed, kinds[0]), pa.array(spans, kinds[1])]
                yield pa.RecordBatch.from_arrays(columns + [batch.column(1)] * whole, ["doc_id", "n_words", "n_hit", "items", "spans"] + ["row"] * whole)
            else:
                kind = pa.list_(pa.struct([("item", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, kind)], ["doc_id", "given", "hits"])

    return scan


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_nodes: int = NODES, whole: bool = False) -> DataFrame:
    """documents (doc_id, text), items (item_id, text) -> RESULT; spans are offsets in code points, end exclusive.

    whole: with the document's columns, in a struct `row` where their names clash with nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A word begins a window of `window` nodes at most; blanks and signs between words make this an upper bound.
    total = items.agg(F.sum(F.size(F.split(F.lower("text"), "[^a-z0-9\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    passes = max(1, -(-total * window // most_nodes))
    given = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if whole else F.col("text")
    out = docs.select("doc_id", given.alias("given"), F.array().cast(HITS).alias("hits"))
    middle = T.StructType(out.schema.fields)
    end = T.StructType([*T.StructType.fromDDL(RESULT).fields, *([T.StructField("row", middle["given"].dataType)] if whole else [])])
    for k in range(passes):
        mine = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        own = spark.sparkContext.broadcast([(r["item_id"], b" ".join(words(r["text"]))) for r in mine.collect()])
        last = k == passes - 1
        out = out.mapInArrow(_scanner(own, window, last, whole), end if last else middle)
    return out


def verdict(found: DataFrame) -> DataFrame:
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The query's rows in DuckDB's SQL: all windows of all texts, as strings, joined with the items'.
SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
given AS (SELECT item_id, least({WINDOW}, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS i, ws FROM b WHERE len(ws) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS key FROM given),
sizes AS (SELECT DISTINCT n FROM wanted),
places AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, sizes WHERE len(ws) >= n),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN wanted w ON p.n = w.n AND array_to_string(ws[i:i + p.n - 1], ' ') = w.key),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY 1),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict(find_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
