"""Quality rules: a learned decision list over text statistics, as ordered Spark conditions.

Statistics are SQL functions of each row by itself. Sequential covering learns from the statistics of a bounded sample
of labelled documents: a rule is grown from two thirds of them, a threshold at a time, by information gain on bad
documents; pruned from its end on the last third; and kept while it is precise there. What it covers is taken out and
the next is learnt. The list becomes one CASE expression, the first rule that holds deciding.

Repeated three-word windows are found by sorting each text's window hashes, so a text costs n log n of its words.

A null or empty text has no words, all counts 0, and fails the base rule. Nulls in labels leave a row out; several
labels of a doc_id are averaged. Without both labels no rule is learnt and the base rule alone decides. Rows are
judged one by one: equal rows and null doc_ids don't matter, and other columns are left out. A very long text is
counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.session import read_table, spread

#: Labelled documents to learn from at most.
SAMPLE = 6_000
PRECISION = 0.9
MOST_RULES, MOST_CONDITIONS = 12, 4
#: The contract's white space, symbols and base limits.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks", "line_words")


def statistics(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, FEATURES."""
    text, without = F.col("text"), lambda chars: F.translate(F.col("text"), chars, "")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"),
        F.length(without(SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("n_capitals"),
        (F.length(text) - F.length(without("!?;:/\\{}[]()=_"))).alias("n_marks"),
    )
    n = F.size("w")
    hashed = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)))
    rows = rows.select("*", n.cast("long").alias("n"), F.when(n >= 3, hashed).otherwise(F.array().cast("array<long>")).alias("win")).drop("w")
    rows = rows.withColumn("sorted", F.sort_array("win"))
    twice = F.exists(F.sequence(F.lit(1), F.size("sorted") - 1), lambda i: F.get("sorted", i) == F.get("sorted", i - 1))
    rows = rows.withColumn("twice", F.when(F.size("sorted") >= 2, twice).otherwise(False)).drop("sorted")
    pairs = F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("pairs", F.when(F.col("twice"), pairs)).drop("win")
    same = lambda p, j: F.coalesce(F.get("pairs", j)["h"] == p["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("pairs", lambda p, i: F.when(i > 0, same(p, i - 1)).otherwise(False) | same(p, i + 1)), lambda p: p["i"]))
    rows = rows.withColumn("at", F.when(F.col("twice"), at)).drop("pairs")
    covered = F.aggregate(F.transform("at", lambda a, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - a, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("n_repeat_words", F.when(F.col("twice"), covered).otherwise(0).cast("long")).drop("at", "twice")
    rows = rows.withColumn("n_lines", F.size("lines")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    words = F.greatest("n", F.lit(1)).cast("double")
    return rows.select(
        "doc_id", F.col("n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("word_length"), (F.col("n_symbols") / words).alias("symbols"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_lines"), (F.col("n_repeat_words") / words).alias("repeats"),
        (F.col("n_capitals") / F.greatest("word_chars", F.lit(1))).alias("capitals"), (F.col("n_marks") / words).alias("marks"), (F.col("n") / F.greatest("n_lines", F.lit(1))).alias("line_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        own = x[:, FEATURES.index(self.feature)]
        return own >= self.threshold if self.above else own <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), bool))


def grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Thresholds by most information gained on the bad rows, until no good row is left."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (~bad[inside]).any():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        before, best, choice = np.log2(p / (p + n)), 1e-9, None
        for f, feature in enumerate(FEATURES):
            values, order = x[inside, f], np.argsort(x[inside, f], kind="stable")
            v, b = values[order], bad[inside][order]
            edges = np.flatnonzero(v[1:] != v[:-1]) + 1
            if not len(edges):
                continue
            below = np.r_[0, np.cumsum(b)][edges]
            for above, got, size in ((False, below, edges), (True, p - below, len(v) - edges)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(got > 0, got * (np.log2(got / size) - before), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, choice = gain[k], Condition(feature, above, float((v[edges[k]] + v[edges[k] - 1]) / 2))
        if choice is None:
            break
        rule.append(choice)
        inside &= choice.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that serves rows best that it was not grown from."""

    def worth(r: Rule) -> float:
        hit = covers(r, x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - 4 * n) / max(1, p + n)

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 3, precision: float = PRECISION) -> list[Rule]:
    """Rules for bad rows, in order; none if there are no rows of either kind."""
    rules: list[Rule] = []
    third = np.random.default_rng(seed).permutation(len(x)) % 3 == 0
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES:
        growing, pruning = left & ~third, left & third
        if not bad[growing].any() or bad[growing].all():
            break
        if not (rule := grow(x[growing], bad[growing])):
            break
        rule = prune(rule, x[pruning], bad[pruning]) if bad[pruning].any() else rule
        hit = covers(rule, x) & left
        fresh = hit & pruning
        # Laplace's estimate on all rows and, where there are enough, on those that the rule has not seen.
        if (bad[hit].sum() + 1) / (hit.sum() + 2) < precision or fresh.sum() >= 10 and bad[fresh].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True: kept. The first rule that holds rejects."""
    out = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, (c.column() for c in rule))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def rule_number(rules: list[Rule]) -> Column:
    """The number of the rule that rejects a row, from 1; 0 for none."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(reduce(lambda a, b: a & b, (c.column() for c in rules[k - 1])), F.lit(k)).otherwise(out)
    return out


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the statistics of at most `sample` labelled documents, those whose doc_ids hash lowest."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    own = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # `sample` rows of two numbers, and then of as many numbers as there are features.
    rows = statistics(docs.join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(own), "doc_id")
    # Of several rows of a doc_id the least is taken.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", *FEATURES)).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r["label"] < 0.5 for r in rows], bool))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics with base_failed, rule and kept. Write the rows before filtering by a verdict: Catalyst would push
    such a filter below the statistics and compute them again inside it."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("rule", rule_number(rules)).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rules = learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
