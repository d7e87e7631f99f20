"""Evaluation of systems by prompt: pairwise Jaccard, rates with unavailable values, and report tables.

results: system, prompt_id, pos (order of prompts), success, extracted_methods, mentions_*; prompts: prompt_id,
expected_geometry, ground_truth, failure. A rate is null where any of its values is; failed rows count apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.vectors import jaccard
from lumenfold.operators.extract import match
from lumenfold.session import cut

#: Blocks of method sets on either side of the pairs.
BLOCKS = 8


def matched(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """results with the prompt's criteria and `details`; a prompt without criteria gives a null match."""
    # The prompts of an evaluation are written by hand; a join strategy is left to their size.
    own = prompts.select("prompt_id", "expected_geometry", "ground_truth", "failure")
    return results.join(own, "prompt_id", "left").withColumn("details", match())


def method_sets(results: DataFrame) -> DataFrame:
    lowered = F.array_distinct(F.transform(F.coalesce("extracted_methods", F.array().cast("array<string>")), F.lower))
    return results.where("success").select("system", "prompt_id", "pos", lowered.alias("methods"))


def jaccard_pairs(results: DataFrame) -> DataFrame:
    """A row for each pair of a system's prompts: pair (a JSON array), similarity."""
    a, b = method_sets(results).alias("a"), method_sets(results).alias("b")
    pairs = a.join(b, (F.col("a.system") == F.col("b.system")) & (F.col("a.pos") < F.col("b.pos")))
    name = F.concat(F.lit("["), F.to_json(F.array("a.prompt_id")).substr(F.lit(2), F.length(F.to_json(F.array("a.prompt_id"))) - 2), F.lit(", "), F.to_json(F.array("b.prompt_id")).substr(F.lit(2), F.length(F.to_json(F.array("b.prompt_id"))) - 2), F.lit("]"))
    return pairs.select(F.col("a.system").alias("system"), name.alias("pair"), jaccard(F.col("a.methods"), F.col("b.methods")).alias("similarity"))


def jaccard_map(results: DataFrame) -> DataFrame:
    """system, pairs: a map from each pair of a system's prompts to its similarity; a system's prompts are one design."""
    return jaccard_pairs(results).groupBy("system").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", "similarity")))).alias("pairs"))


def pair_statistics(sets: DataFrame) -> DataFrame:
    """(system, methods, n prompts that have that set) -> system, mean, min, max and number of pairs of prompts.

    Prompts with equal sets are counted, not paired, so the join is over distinct sets only. It is dealt by blocks of
    sets on both sides, so a system with most of the sets is BLOCKS * BLOCKS tasks.
    """
    keyed = sets.select("system", "methods", "n", F.to_json("methods").alias("k")).withColumn("own", F.pmod(F.xxhash64("k"), F.lit(BLOCKS)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    a = keyed.withColumns({"i": F.col("own"), "j": every}).alias("a")
    b = keyed.withColumns({"j": F.col("own"), "i": every}).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("system", "i", "j")))
    unlike = a.join(b, same & (F.col("a.k") < F.col("b.k"))).select(F.col("a.system").alias("system"), jaccard(F.col("a.methods"), F.col("b.methods")).alias("s"), (F.col("a.n") * F.col("b.n")).alias("w"))
    equal = sets.where("n > 1").select("system", F.lit(1.0).alias("s"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("w"))
    return unlike.union(equal).groupBy("system").agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("mean"), F.min("s").alias("min"), F.max("s").alias("max"), F.sum("w").alias("pairs"))


def jaccard_summary(results: DataFrame) -> DataFrame:
    """system, mean, min, max and number of pairs of its prompts; nulls below two prompts.

    The distinct sets are written once, so that what made the results, such as an extraction, runs once as well.
    """
    sets = cut(method_sets(results).groupBy("system", F.array_sort("methods").alias("methods")).agg(F.count(F.lit(1)).alias("n")))
    return results.select("system").distinct().join(pair_statistics(sets), "system", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def profiles(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """How many of a system's rows have the same outcome: system, success, matches, clustering, methods, n; written once."""
    lowered = F.array_sort(F.array_distinct(F.transform(F.coalesce("extracted_methods", F.array().cast("array<string>")), F.lower)))
    rows = matched(results, prompts).select("system", F.coalesce("success", F.lit(False)).alias("success"), F.col("details.matches").alias("matches"), F.col("mentions_clustering").alias("clustering"), lowered.alias("methods"))
    return cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))


def system_metrics(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """Rates by system over its successful rows. The match rate is null where a single match is."""
    rows = profiles(results, prompts)
    good = F.col("success")
    number = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    rate = lambda flag: number(good & F.col(flag)) / F.nullif(number(good & F.col(flag).isNotNull()), F.lit(0))
    rates = rows.groupBy("system").agg(
        F.when(number(good) == number(good & F.col("matches").isNotNull()), rate("matches")).alias("ground_truth_match_rate"),
        rate("clustering").alias("clustering_for_all_rate"), number(good).alias("prompts_evaluated"), number(~good).alias("prompts_failed"),
    )
    pairs = pair_statistics(rows.where(good).groupBy("system", "methods").agg(F.sum("n").alias("n")))
    named = pairs.select("system", F.col("mean").alias("jaccard_similarity_across_prompts"), F.col("min").alias("jaccard_min"), F.col("max").alias("jaccard_max"))
    return rates.join(named, "system", "left")


def format_metric(value: Column, spec: str = ".2f") -> Column:
    """Text of a number, n/a without one; ties of its decimal digits go to the even one."""
    digits, percent = int(spec[1]), spec.endswith("%")
    rounded = F.bround(value.cast("double") * (100 if percent else 1), digits)
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.format_string(f"%.{digits}f" + "%%" * percent, rounded))


def summary_table(metrics: DataFrame, kind: str = "markdown") -> DataFrame:
    """One row, `summary`: the table's text, systems in order of name. Metrics have a row a system.

    Headings and rules are fixed values.
    """
    j, g, c = (F.col(n) for n in ("jaccard_similarity_across_prompts", "ground_truth_match_rate", "clustering_for_all_rate"))
    if kind == "markdown":
        row = F.concat(F.lit("| "), F.col("system"), F.lit(" | "), format_metric(j), F.lit(" | "), format_metric(g, ".1%"), F.lit(" | "), format_metric(c, ".1%"), F.lit(" |"))
        before = ["| System | Jaccard (Invariance) | Ground Truth Match | Clustering-for-All |", "|--------|---------------------|-------------------|-------------------|"]
        after: list[str] = []
    elif kind == "latex":
        percent = lambda x: F.replace(format_metric(x, ".0%"), F.lit("%"), F.lit(r"\%"))
        row = F.concat(F.col("system"), F.lit(" & "), format_metric(j), F.lit(" & "), percent(g), F.lit(" & "), percent(c), F.lit(r" \\"))
        before = [r"\begin{tabular}{lccc}", r"\toprule", r"System & Jaccard & GT Match & Cluster-All \\", r"\midrule"]
        after = [r"\bottomrule", r"\end{tabular}"]
    else:
        raise ValueError(f"unknown format {kind!r}")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("system", row.alias("line")))), lambda x: x["line"])
    fixed = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    return metrics.agg(F.concat_ws("\n", F.concat(fixed(before), lines, fixed(after))).alias("summary"))


def scenarios(prompts: DataFrame) -> DataFrame:
    return prompts.select("prompt_id", F.coalesce("expected_geometry", F.lit("unknown")).alias("expected_geometry"), F.concat_ws(", ", F.coalesce("ground_truth", F.array().cast("array<string>"))).alias("ground_truth"))


def recommendations(results: DataFrame) -> DataFrame:
    """Of successful rows: the first ten methods and the categories that they belong to."""
    return results.where("success").select("system", "prompt_id", F.concat_ws(", ", F.slice("extracted_methods", 1, 10)).alias("methods"), F.concat_ws(", ", F.array_sort(F.map_keys("by_category"))).alias("categories"))


def failures(results: DataFrame, prompts: DataFrame) -> DataFrame:
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit("Yes")).otherwise(F.lit("No"))
    return matched(results, prompts).where("success").select("system", "prompt_id", F.coalesce("expected_geometry", F.lit("unknown")).alias("expected_geometry"), yes(F.col("mentions_clustering")).alias("recommends_clustering"), yes(F.col("details.matches")).alias("matches_ground_truth"))


def prompt_metrics(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """Long form, a row a measured number; what is unavailable has none."""
    rows = matched(results, prompts).where("success").select("system", "prompt_id", F.size("extracted_methods").cast("double").alias("method_count"), *(F.col(f"mentions_{c}").cast("double").alias(f"mentions_{c}") for c in ("clustering", "trajectory", "data_inspection")), F.col("details.matches").cast("double").alias("matches_ground_truth"))
    return rows.unpivot(["system", "prompt_id"], [c for c in rows.columns if c not in ("system", "prompt_id")], "metric", "value").where("value is not null")
