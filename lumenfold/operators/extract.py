"""Methods that a text recommends: names and phrases, minus those that a local cue rejects.

Everything happens inside the row, so the operator needs no shuffle. One pass over a text finds the words that names can
start with, and only those names are searched for; a phrase, which may start inside a word, where its letters occur. Each
mention is kept or rejected by its clause, which is looked for around the mention and not in the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import vocabulary as v
from lumenfold.functions.text import let, method_key, plain, spans

FLAGGED = ("clustering", "trajectory", "cell_cycle", "spatial")


#: Characters before a mention that are searched for the end of the clause before, first.
NEAR = 400
SIGN = "(?U)" + v.BOUNDARY


def mentions(text: Column) -> Column:
    """All mentions in a plain text. A pattern is tried only where a word that its matches can start with occurs, and the
    letters that each of them has."""
    named, phrases = ([x for x in v.patterns() if bool(v.first_words(x[1], x[2])) == whole] for whole in (True, False))
    entry = lambda c, m, p, n: F.struct(F.lit(c).alias("category"), F.lit(m).alias("method"), F.lit(v.quick(p)).alias("pattern"), F.lit(n).alias("needle"))
    by_word: dict[str, list[int]] = {}
    for i, (_, m, p, _) in enumerate(named):
        for word in v.first_words(m, p):
            by_word.setdefault(word, []).append(i)
    words, listed = sorted(by_word), F.array(*(entry(*x) for x in named))
    # Everything that isn't a plain letter, digit or underscore parts words here, so no name is missed.
    own = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<![a-z0-9_]){v.either(set(words))}(?![a-z0-9_])"), F.lit(0)))
    places = F.array(*(F.array(*map(F.lit, by_word[w])) for w in words))
    meant = F.array_distinct(F.flatten(F.transform(own, lambda w: F.get(places, (F.array_position(F.array(*map(F.lit, words)), w) - 1).cast("int")))))
    none = F.array().cast("array<struct<category: string, method: string, pattern: string, needle: string>>")
    some = F.when(text.rlike(v.either({n for *_, n in phrases})), F.array(*(entry(*x) for x in phrases))).otherwise(none)
    tried = F.concat(F.transform(meant, lambda i: F.get(listed, i)), some)
    each = lambda k: F.transform(spans(text, k["pattern"]), lambda s: F.struct(k["category"].alias("category"), k["method"].alias("method"), s["start"].alias("start"), s["end"].alias("end")))
    return F.flatten(F.transform(F.filter(tried, lambda k: F.contains(text, k["needle"])), each))


def clause(text: Column, m: Column) -> tuple[Column, Column]:
    """What stands in a mention's clause before and after it.

    The clause before ends at the last sign of its kind; one close to the mention is the last of all, unless it stands
    where the characters were cut, which might be the rest of a longer word.
    """
    head = F.substring(text, F.lit(1), m["start"] + 1)
    close = F.split(F.substring(head, F.lit(-NEAR - 1), F.lit(NEAR + 1)), SIGN, -1)
    last = lambda c: F.when((F.size(c) > 2) | (F.size(c) == 2) & (F.get(c, F.lit(0)) != "") | (m["start"] < NEAR), F.element_at(c, -1)).otherwise(F.element_at(F.split(head, SIGN, -1), -1))
    before = let(let(close, last), lambda x: F.substring(x, F.lit(1), F.length(x) - 1))
    after = F.substring(F.element_at(F.split(F.substring(text, m["end"], F.length(text)), SIGN, 2), 1), F.lit(2), F.length(text))
    return before, after


def widest(found: Column) -> Column:
    """Distinct spans of mentions that lie in no other, by start."""
    own = F.array_sort(F.array_distinct(F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))))
    inside = lambda a, b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & ((a["start"] != b["start"]) | (a["end"] != b["end"]))
    return let(own, lambda all_of: F.filter(all_of, lambda a: ~F.exists(all_of, lambda b: inside(a, b))))


def rejected(text: Column, wide: Column, m: Column) -> Column:
    said = F.struct(*(c.alias(n) for n, c in zip(("before", "after"), clause(text, m), strict=True)))
    return let(said, lambda c: _rejects(c["before"], c["after"], wide, m))


def _rejects(before: Column, after: Column, wide: Column, m: Column) -> Column:
    right = m["end"] + F.length(after)
    # A comma before a fresh subject starts a new thought.
    before = F.when(after.rlike("(?U)" + v.NEW_SUBJECT), F.substring_index(before, ",", -1)).otherwise(before)
    parts = F.split(F.regexp_replace(before, "(?U)" + v.DOUBLE_NEGATION, "use"), "(?U)" + v.REJECTION, -1)
    tail = F.element_at(parts, -1)
    ahead = (F.size(parts) > 1) & (F.size(F.regexp_extract_all(tail, F.lit(r"(?U)\b\w+\b"), F.lit(0))) <= v.MOST_WORDS) & ~tail.rlike("(?U)" + v.AFFIRMATION)
    listed = F.reverse(F.filter(wide, lambda s: (s["start"] >= m["end"]) & (s["end"] <= right)))
    masked = F.aggregate(listed, after, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"] - m["end"]), F.lit("METHOD"), F.substring(t, s["end"] - m["end"] + 1, F.length(t))))
    return ahead | masked.rlike("(?U)" + v.CONDEMNED)


def extract_methods(df: DataFrame, text: str = "text") -> DataFrame:
    """df with extracted_methods (sorted), by_category (map) and the five mentions_* flags."""
    rows = df.withColumn("__text", plain(F.coalesce(F.col(text), F.lit("")))).withColumn("__found", mentions(F.col("__text")))
    rows = rows.withColumn("__wide", widest(F.col("__found")))
    rows = rows.withColumn("__kept", F.filter("__found", lambda m: ~rejected(F.col("__text"), F.col("__wide"), m)))
    in_category = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter("__kept", lambda m: m["category"] == c), lambda m: m["method"])))
    rows = rows.withColumn("extracted_methods", F.array_sort(F.array_distinct(F.transform("__kept", lambda m: m["method"]))))
    everything = F.map_from_arrays(F.array(*map(F.lit, v.METHODS)), F.array(*map(in_category, v.METHODS)))
    rows = rows.withColumn("by_category", F.map_filter(everything, lambda _, ms: F.size(ms) > 0))
    mentioned = lambda c: F.exists("__kept", lambda m: m["category"] == c)
    rows = rows.withColumns({f"mentions_{c}": mentioned(c) for c in FLAGGED})
    likely = F.col("__text").rlike(v.either({v.needle(p) for p in v.INSPECTION}))
    rows = rows.withColumn("mentions_data_inspection", likely & F.col("__text").rlike("(?U)" + "|".join(v.INSPECTION)))
    return rows.drop("__text", "__found", "__wide", "__kept")


def keys(methods: Column) -> Column:
    return F.array_distinct(F.transform(methods, method_key))


def match(extracted: str = "extracted_methods", expected: str = "ground_truth", failing: str = "failure") -> Column:
    """struct<matches, ground_truth_matches, failure_matches, total_extracted, match_ratio>; matches is null without criteria."""
    none = F.array().cast("array<string>")
    own, want, bad = (keys(F.coalesce(F.col(c), none)) for c in (extracted, expected, failing))
    hits, fails = F.array_sort(F.array_intersect(own, want)), F.array_sort(F.array_intersect(own, bad))
    return F.struct(
        F.when(F.size(want) > 0, (F.size(hits) > 0) & (F.size(fails) == 0)).alias("matches"), hits.alias("ground_truth_matches"), fails.alias("failure_matches"),
        F.size(own).alias("total_extracted"), F.when(F.size(want) > 0, F.size(hits) / F.size(want)).alias("match_ratio"),
    )


def violations(beta0: str = "beta0", beta1: str = "beta1") -> list[Column]:
    """clustering_violation, cell_cycle_violation, any_violation and violation_details."""
    clusters = F.coalesce((F.col(beta0) == 1) & F.col("mentions_clustering"), F.lit(False))
    cycle = F.coalesce((F.col(beta1) == 0) & F.col("mentions_cell_cycle"), F.lit(False))
    details = F.array_compact(F.array(
        F.when(clusters, F.concat(F.lit("Clustering recommended but data has beta0="), F.col(beta0).cast("string"), F.lit(" (single component)"))),
        F.when(cycle, F.concat(F.lit("Cell cycle methods recommended but data has beta1="), F.col(beta1).cast("string"), F.lit(" (no loops)"))),
    ))
    return [clusters.alias("clustering_violation"), cycle.alias("cell_cycle_violation"), (clusters | cycle).alias("any_violation"), details.alias("violation_details")]
