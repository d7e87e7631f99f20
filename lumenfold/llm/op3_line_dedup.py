"""Line dedup: a segment-partition edit join over the distinct lines of all documents.

Two lines within THRESHOLD edits share one of the THRESHOLD + 1 segments that the shorter (or either, if equally long)
falls into, in a place that the edits before and after it allow. So each line is put under its segments, with its
length, and looks up those substrings of itself that could be a segment of a line up to THRESHOLD shorter. Keys that
only one line has are dropped. What is asked of a line is whether a similar one comes before it, so the lines of a key
meet in a left semi join that verifies inside: a row comes out for a line and key at most, never one for a pair, a line
is done with at its first match, and Spark can split a key with many lines. Lengths and counts of letters by class,
which an edit moves by two at most, rule out most pairs first. Then bits of a word stand for the diagonals of the band,
a word for each number of edits, and a character updates all diagonals at once.

A line is removed if an equal line, or another within THRESHOLD edits, comes first, in order of (doc_id, place in the
document). Lines of fewer than MIN_CHARS code points are not in the edit join, since two edits may turn one short line
into another that says something else. With `every`, as in the query and the pipeline, equal ones are removed all the
same, if they have a character that isn't blank; without it they stay. What is left keeps its order and line breaks.

A null text stays null and has no lines; an empty one has a line that stays. Null doc_ids come first in order, as one
document. Rows equal in doc_id and text are treated alike; equal lines in rows of one doc_id at one place are all
first, and of similar ones there neither comes before the other. A line of any length is compared whole, and its cost
is in proportion to its length. Other columns are kept by `remove_repeated`, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import let
from lumenfold.session import cut, read_table

THRESHOLD = 2
MIN_CHARS = 24
#: A table is broadcast up to this size, counted before; beyond it joins are by key.
BROADCAST_BYTES = 24_000_000
#: One text of so many is looked at for hot keys; a hot key has so many lines there and is among the 1 / HOT_SHARE most
#: frequent; its rows are dealt to SALTS groups.
SAMPLED, HOT_LEAST, HOT_SHARE, SALTS = 500, 50, 1e-4, 64
CLASSES = ("aeo", "iu", "nst", "rlh", "dcm", "bpfgvw", "0123456789", " .,;:")


def lines(docs: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, th (the text's hash), pos, line, of lines long enough, or of every line that isn't blank as well."""
    # The hash is made below the lines: beside them it would be made anew for each.
    hashed = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = hashed.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    long = F.length("line") >= MIN_CHARS
    return found.where(long | F.col("line").rlike(r"\S") if every else long)


def place() -> Column:
    """Order of lines, as a number that hash aggregation can keep in place."""
    return F.coalesce("doc_id", F.lit(-(2**63))).cast("decimal(38,0)") * F.lit(2**32).cast("decimal(11,0)") + F.col("pos")


def line_ids() -> list[Column]:
    return [F.xxhash64("line").alias("id"), F.xxhash64(F.lit(7), "line").alias("id2")]


def segment(length: Column, number: int, threshold: int) -> tuple[Column, Column]:
    """First place (from 1) and length of a segment of lines of that length; the last ones take what is left over."""
    count = threshold + 1
    short, long_from = F.floor(length / count).cast("int"), count - length % count
    extra = lambda k: F.greatest(F.lit(0), F.lit(k) - long_from)
    return short * number + extra(number) + 1, short + extra(number + 1) - extra(number)


def keyed(distinct: DataFrame, threshold: int) -> DataFrame:
    """Rows with `line` -> key, id and, in the lowest bit of id, whether the key is one of the line's own segments; the
    others are substrings that may be segments of lines as long or shorter.

    Places of segments are computed once a line and the keys by one short lambda over a table: written out one by one
    they make a method too long for the JVM's compiler.
    """
    count, steps = threshold + 1, []
    for shorter in range(count):
        for i in range(count):
            # Edits before the segment shift it by their number at most, and so do those after it, from the other end.
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i))
            steps += [(shorter, i, shift) for shift in range(low, high + 1)]
    table = F.array(*(F.struct(F.lit(s).alias("shorter"), F.lit(i).alias("i"), F.lit(d).alias("shift"), F.lit(int(s == d == 0)).cast("long").alias("own")) for s, i, d in steps))
    placed = lambda which: F.array(*(F.array(*(segment(F.col("n") - s, i, threshold)[which].cast("int") for i in range(count))) for s in range(count)))
    of = lambda name, t: F.get(F.get(F.col(name), t["shorter"]), t["i"])
    key = lambda t: F.xxhash64(F.col("n") - t["shorter"], t["i"], F.substring(F.col("line"), of("at", t) + t["shift"], of("size", t)))
    rows = distinct.select("line", F.length("line").alias("n")).select("line", "n", placed(0).alias("at"), placed(1).alias("size"))
    rows = rows.select(even(F.xxhash64("line")).alias("id"), F.explode(F.transform(table, lambda t: even(key(t)).bitwiseOR(t["own"]))).alias("k"))
    return rows.select(even(F.col("k")).alias("key"), F.col("id").bitwiseOR(F.col("k").bitwiseAND(F.lit(1))).alias("id"))


def even(number: Column) -> Column:
    return number.bitwiseAND(F.lit(-2))


def within(left: Column, right: Column, threshold: int) -> Column:
    """Whether two texts are within that many edits."""
    width = 2 * threshold + 1
    band = (1 << width) - 1
    names = [f"r{d}" for d in range(threshold + 1)]

    def masks(a: Column, b: Column, i: Column) -> Column:
        """Bit k: b has a's character i, k - threshold places further on."""
        bits = [F.when(F.get(b, F.greatest(i + k - threshold, F.lit(-1))) == F.get(a, i), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    def update(state: Column, m: Column) -> Column:
        new: list[Column] = []
        for d, name in enumerate(names):
            r = state[name].bitwiseAND(m)
            if d:
                less = state[names[d - 1]]
                r = r.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(band))
            new.append(r)
        return F.struct(*(r.alias(n) for r, n in zip(new, names, strict=True)))

    start = F.struct(*(F.lit(sum(1 << (threshold + k) for k in range(d + 1))).alias(n) for d, n in enumerate(names)))

    def walk(p: Column) -> Column:
        a, b = p["a"], p["b"]
        # Without a live diagonal the rest of the line is skipped.
        step = lambda state, i: F.when(state[names[-1]] == 0, state).otherwise(F.get(F.transform(F.array(masks(a, b, i)), lambda m: update(state, m)), F.lit(0)))
        end = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, step, lambda s: s[names[-1]])
        return F.call_function("shiftright", end, F.size(b) - F.size(a) + threshold).bitwiseAND(F.lit(1)) == 1

    # The characters are bound to a variable of the lambda, so they are split once a pair and not once a step.
    characters = F.array(F.struct(F.split(left, "").alias("a"), F.split(right, "").alias("b")))
    return F.when(F.abs(F.length(left) - F.length(right)) <= threshold, F.get(F.transform(characters, walk), F.lit(0))).otherwise(False)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its rows, counted, take few enough bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def hot_keys(docs: DataFrame, threshold: int) -> DataFrame:
    """hot_key: keys that a share of a sample's lines have, HOT_SHARE at least; so there are few, whatever the input.

    The sample decides only which keys are dealt out over tasks. What comes out of them is the same.
    """
    sample = lines(docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)).select("line").distinct()
    counted = keyed(sample, threshold).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_LEAST)
    # The most frequent first, as many as can each have that share.
    return cut(counted.orderBy(F.desc("n"), "key").limit(int(1 / HOT_SHARE)).select(F.col("key").alias("hot_key")))


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, every: bool = False) -> DataFrame:
    """id, id2, first (place) and near (whether a similar line comes first) of the distinct lines that repeat or are near."""
    all_lines = lines(docs)
    distinct = all_lines.groupBy("line").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("n"))
    coded = keyed(distinct, threshold)
    # A key with a large share of the lines is dealt out; it has several lines, so it needs no look at the others.
    hot = F.broadcast(hot_keys(docs, threshold))
    dealt = F.xxhash64("key", F.pmod(F.shiftright("id", 1), F.lit(SALTS)))
    coded = coded.join(hot, coded["key"] == hot["hot_key"], "left").select(F.when(F.col("hot_key").isNull(), F.col("key")).otherwise(dealt).alias("key"), "id", "hot_key")
    group = Window.partitionBy("key")
    # Plain columns in the window, so that few numbers a row are exchanged; the lowest bit of id tells own segments.
    shared = coded.select("*", F.min("id").over(group).alias("low"), F.max("id").over(group).alias("high"), F.bit_or("id").over(group).alias("any"))
    several, used = even(F.col("low")) != even(F.col("high")), F.col("any").bitwiseAND(F.lit(1)) == 1
    shared = cut(shared.where(F.col("hot_key").isNotNull() | (several & used)).select(F.coalesce("hot_key", "key").alias("key"), even(F.col("id")).alias("id"), (F.col("id").bitwiseAND(F.lit(1)) == 1).alias("own")))
    # The lines behind those keys, with their texts.
    needed = small(shared.select("id").distinct(), 64)
    texts = all_lines.withColumn("id", even(F.xxhash64("line"))).join(needed, "id", "left_semi")
    texts = texts.groupBy("id", "line").agg(F.min(place()).alias("first"))
    letters = F.lower("line")
    counts = [(F.length("line") - F.length(F.translate(letters, c, ""))).alias(f"c{k}") for k, c in enumerate(CLASSES)]
    sides = cut(shared.join(texts.select("id", "line", "first", F.length("line").alias("len"), *counts), "id"))
    near = sides.alias("x").join(sides.alias("y"), precedes(threshold), "left_semi").select("line").distinct().select(*line_ids(), F.lit(True).alias("near"))
    repeated = lines(docs, every).select(*line_ids(), place().alias("at")).groupBy("id", "id2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "id2", "first")
    return cut(repeated.join(near, ["id", "id2"], "full").select("id", "id2", "first", F.coalesce("near", F.lit(False)).alias("near")))


def precedes(threshold: int) -> Column:
    """Whether y, under the same key as x, comes before it and is within that many edits; cheap tests first."""
    x, y = lambda n: F.col(f"x.{n}"), lambda n: F.col(f"y.{n}")
    apart = reduce(lambda a, b: a + b, (F.abs(x(f"c{k}") - y(f"c{k}")) for k in range(len(CLASSES))))
    likely = (x("own") | y("own")) & (y("first") < x("first")) & (F.abs(x("len") - y("len")) <= threshold) & (apart <= 2 * threshold) & (x("line") != y("line"))
    return (x("key") == y("key")) & likely & within(x("line"), y("line"), threshold)


def removals(docs: DataFrame, threshold: int = THRESHOLD, every: bool = False) -> DataFrame:
    """doc_id, th, exact and near: places of the lines to remove from each text that has any."""
    classes = line_classes(docs, threshold, every)
    found = lines(docs, every).select("doc_id", "th", "pos", place().alias("at"), *line_ids()).join(small(classes, 96), ["id", "id2"])
    exact = F.col("first").isNotNull() & (F.col("at") > F.col("first"))
    found = found.where(F.col("near") | exact)
    return found.groupBy("doc_id", "th").agg(F.collect_set(F.when(~F.col("near"), F.col("pos"))).alias("exact"), F.collect_set(F.when(F.col("near"), F.col("pos"))).alias("near"))


def remove_repeated(docs: DataFrame, threshold: int = THRESHOLD, names: tuple[str, str, str] = ("n_lines", "exact", "near"), every: bool = False) -> DataFrame:
    """docs with the lines removed from text, then n_lines, exact and near (places of removed lines, from 0)."""
    gone = cut(removals(docs.select("doc_id", "text"), threshold, every).toDF("__lf_doc", "__lf_hash", "__lf_exact", "__lf_near"))
    joined = docs.join(small(gone, 160), F.col("doc_id").eqNullSafe(F.col("__lf_doc")) & (F.xxhash64("text") == F.col("__lf_hash")), "left")
    none = F.array().cast("array<int>")
    exact, near = F.coalesce("__lf_exact", none), F.coalesce("__lf_near", none)
    own, drop = F.split("text", "\n"), F.concat(exact, near)
    # Places less places, by a set of them, so a text of many repeated lines costs what its lines do.
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(lines, i))
    left = F.array_join(let(own, stay), "\n")
    text = F.when(F.size(drop) == 0, F.col("text")).otherwise(left)
    kept = [text.alias("text") if n == "text" else F.col(f"`{n}`") for n in docs.columns]
    return joined.select(*kept, F.when(F.col("text").isNull(), 0).otherwise(F.size(own)).cast("long").alias(names[0]), F.array_sort(exact).alias(names[1]), F.array_sort(near).alias(names[2]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), every=True)
    return cleaned.select("doc_id", "n_lines", F.size("exact").cast("long").alias("n_exact"), F.size("near").cast("long").alias("n_near"), F.array_join("near", ",").alias("near"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


#: The letters beyond ASCII of the documents, and as many signs that don't occur there: DuckDB's distance counts bytes.
_LETTERS, _SIGNS = "éóèñüçöäêßíÉÈÑÓÇÊÜÖÄÍ", "".join(map(chr, [*range(1, 9), *range(14, 27)]))
#: The query's rows in DuckDB's SQL: all lines, and all pairs of long ones by their edit distance.
SQL = f"""WITH l AS (SELECT doc_id, doc_id::HUGEINT * 4294967296 + k - 1 AS place, k - 1 AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)),
f AS (SELECT line, min(place) AS first, length(line) AS n, translate(line, '{_LETTERS}', '{_SIGNS}') AS plain FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY line),
long AS (SELECT * FROM f WHERE n >= {MIN_CHARS}),
near AS (SELECT DISTINCT a.line FROM long a JOIN long b ON b.n BETWEEN a.n - {THRESHOLD} AND a.n + {THRESHOLD} WHERE b.first < a.first AND levenshtein(a.plain, b.plain) <= {THRESHOLD}),
seen AS (SELECT l.*, near.line IS NOT NULL AS is_near, near.line IS NULL AND f.line IS NOT NULL AND place > f.first AS is_exact FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line)),
texts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_exact) AS n_exact, count(*) FILTER (is_near) AS n_near, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (is_near), '') AS near, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_near AND NOT is_exact), '') AS text FROM seen GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(t.near, '') AS near, md5(coalesce(t.text, '')) AS text_md5 FROM documents d LEFT JOIN texts t USING (doc_id)"""
