"""Queries of extraction, matching, agreement and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import evaluate as e
from lumenfold.operators.extract import extract_methods as extract
from lumenfold.operators.extract import violations
from lumenfold.plans.inputs import JUDGED_SQL, NAMES, PROMPTS_SQL, RESULTS_SQL, found_sql, prompts, responses
from lumenfold.session import read_table, shared_path, spread
from lumenfold.sources import loaders, sinks

QUERIES, ORACLES = {}, {}
WITH = f"WITH {PROMPTS_SQL}, {RESULTS_SQL}, {JUDGED_SQL} "
JACCARD = "CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END"


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def results(spark, sf):
    return extract(responses(spark, sf))


@query(WITH + "SELECT doc_id, array_to_string(extracted_methods, ',') AS methods, mentions_clustering, mentions_trajectory, mentions_cell_cycle, false AS mentions_spatial, mentions_data_inspection FROM results")
def extract_methods(spark, sf):
    return results(spark, sf).select("doc_id", F.array_join("extracted_methods", ",").alias("methods"), "mentions_clustering", "mentions_trajectory", "mentions_cell_cycle", "mentions_spatial", "mentions_data_inspection")


def _advised(sf_text: str) -> str:
    """SQL of the methods and flags in whole texts, each with a name recommended and another one rejected after it."""
    names = "[" + ", ".join(f"'{m}'" for m in NAMES) + "]"
    told = f"lower(coalesce({sf_text}, '') || ' Use ' || replace(list_extract({names}, (doc_id % {len(NAMES)} + 1)::INT), '_', ' ') || ' to begin.')"
    return f"SELECT doc_id, list_distinct([x.m FOR x IN f]) AS ms, [x.c FOR x IN f] AS cs FROM (SELECT doc_id, {found_sql(told)} AS f FROM documents)"


@query(f"WITH a AS ({_advised('text')}) SELECT doc_id, array_to_string(list_sort(ms), ',') AS methods, list_contains(cs, 'clustering') AS clustering, list_contains(cs, 'trajectory') AS trajectory, list_contains(cs, 'cell_cycle') AS cell_cycle, list_contains(cs, 'spatial') AS spatial FROM a")
def extract_from_text(spark, sf):
    """Whole texts of the corpus, each with one name of the vocabulary recommended after it and another one rejected."""
    name = lambda k: F.replace(F.get(F.array(*map(F.lit, NAMES)), (k % len(NAMES)).cast("int")), F.lit("_"), F.lit(" "))
    told = F.concat(F.coalesce("text", F.lit("")), F.lit(" Use "), name(F.col("doc_id")), F.lit(" to begin. Avoid "), name(F.col("doc_id") * 7 + 3), F.lit("."))
    found = extract(spread(read_table(spark, sf, "documents")).select("doc_id", told.alias("text")))
    return found.select("doc_id", F.array_join("extracted_methods", ",").alias("methods"), *(F.col(f"mentions_{c}").alias(c) for c in ("clustering", "trajectory", "cell_cycle", "spatial")))


@query(WITH + "SELECT system, prompt_id, doc_id, matches::VARCHAR AS matches, array_to_string(hits, ',') AS hits, array_to_string(fails, ',') AS fails, len(own) AS total_extracted, CASE WHEN len(want) > 0 THEN round(len(hits) / len(want), 6) END AS match_ratio FROM judged")
def ground_truth_match(spark, sf):
    d = e.matched(results(spark, sf), prompts(spark))
    return d.select("system", "prompt_id", "doc_id", F.col("details.matches").cast("string").alias("matches"), F.array_join("details.ground_truth_matches", ",").alias("hits"), F.array_join("details.failure_matches", ",").alias("fails"), F.col("details.total_extracted").cast("long").alias("total_extracted"), F.round("details.match_ratio", 6).alias("match_ratio"))


def by_prompt(spark, sf):
    """Systems' methods by prompt, all of its answers together."""
    rows = results(spark, sf).where("success").groupBy("system", "prompt_id").agg(F.array_distinct(F.flatten(F.collect_set("extracted_methods"))).alias("extracted_methods"))
    return rows.select("system", "prompt_id", F.substring("prompt_id", 2, 9).cast("int").alias("pos"), F.lit(True).alias("success"), "extracted_methods")


BY_PROMPT = "p AS (SELECT system, prompt_id, coalesce(list(DISTINCT m) FILTER (m IS NOT NULL), []) AS ms FROM (SELECT system, prompt_id, unnest(CASE WHEN len(extracted_methods) = 0 THEN [NULL] ELSE extracted_methods END) AS m FROM results WHERE success) GROUP BY 1, 2)"


@query(WITH + f", {BY_PROMPT} SELECT x.system, '[\"' || x.prompt_id || '\", \"' || y.prompt_id || '\"]' AS pair, round({JACCARD.replace('a, b', 'x.ms, y.ms')}, 6) AS similarity FROM p x JOIN p y ON x.system = y.system AND x.prompt_id < y.prompt_id")
def jaccard_pairs(spark, sf):
    return e.jaccard_pairs(by_prompt(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query(WITH + f", {BY_PROMPT} SELECT system, string_agg(pair || '=' || printf('%.4f', s), ';' ORDER BY pair) AS pairs FROM (SELECT x.system, '[\"' || x.prompt_id || '\", \"' || y.prompt_id || '\"]' AS pair, {JACCARD.replace('a, b', 'x.ms, y.ms')} AS s FROM p x JOIN p y ON x.system = y.system AND x.prompt_id < y.prompt_id) GROUP BY 1")
def jaccard_map(spark, sf):
    entries = F.transform(F.array_sort(F.map_entries("pairs")), lambda p: F.concat(p["key"], F.lit("="), F.format_string("%.4f", F.bround(p["value"], 4))))
    return e.jaccard_map(by_prompt(spark, sf)).select("system", F.array_join(entries, ";").alias("pairs"))


PAIRS = f"s AS (SELECT system, extracted_methods AS m, count(*) AS n FROM results WHERE success GROUP BY 1, 2), q AS (SELECT x.system, {JACCARD.replace('a, b', 'x.m, y.m')} AS j, x.n * y.n AS w FROM s x JOIN s y ON x.system = y.system AND x.m < y.m UNION ALL SELECT system, 1.0, n * (n - 1) // 2 FROM s WHERE n > 1), jac AS (SELECT system, sum(j * w) / sum(w) AS mean, min(j) AS min, max(j) AS max, sum(w)::BIGINT AS pairs FROM q GROUP BY 1)"


@query(WITH + f", {PAIRS} SELECT system, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max, coalesce(pairs, 0) AS pairs FROM (SELECT DISTINCT system FROM results) LEFT JOIN jac USING (system)")
def jaccard_summary(spark, sf):
    d = e.jaccard_summary(results(spark, sf))
    return d.select("system", *(F.round(c, 6).alias(c) for c in ("mean", "min", "max")), F.col("pairs").cast("long").alias("pairs"))


METRICS = f", {PAIRS}, metrics AS (SELECT system, CASE WHEN count(*) FILTER (success) = count(matches) FILTER (success) THEN avg(matches::INT) FILTER (success) END AS gt, avg(mentions_clustering::INT) FILTER (success) AS cl, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS bad FROM judged GROUP BY 1)"


@query(WITH + METRICS + " SELECT m.system, round(mean, 6) AS jaccard_similarity_across_prompts, round(min, 6) AS jaccard_min, round(max, 6) AS jaccard_max, round(gt, 6) AS ground_truth_match_rate, round(cl, 6) AS clustering_for_all_rate, ok AS prompts_evaluated, bad AS prompts_failed FROM metrics m LEFT JOIN jac USING (system)")
def system_metrics(spark, sf):
    d = e.system_metrics(results(spark, sf), prompts(spark))
    names = ("jaccard_similarity_across_prompts", "jaccard_min", "jaccard_max", "ground_truth_match_rate", "clustering_for_all_rate")
    return d.select("system", *(F.round(c, 6).alias(c) for c in names), "prompts_evaluated", "prompts_failed")


def judged_only(spark, sf):
    """Systems on the prompts that have criteria, so that rates are available."""
    return e.system_metrics(results(spark, sf).where("prompt_id <> 'p3'"), prompts(spark))


JUDGED_ONLY = WITH.replace("doc_id % 10 = k)", "doc_id % 10 = k WHERE (doc_id // 7) % 4 <> 3)") + METRICS


@query(JUDGED_ONLY + " SELECT m.system, round(gt, 6) AS ground_truth_match_rate, round(mean, 6) AS jaccard FROM metrics m LEFT JOIN jac USING (system)")
def system_rates(spark, sf):
    return judged_only(spark, sf).select("system", F.round("ground_truth_match_rate", 6).alias("ground_truth_match_rate"), F.round("jaccard_similarity_across_prompts", 6).alias("jaccard"))


SHOWN = JUDGED_ONLY + ", shown AS (SELECT m.system, coalesce(printf('%.2f', mean), 'n/a') AS j, gt, cl FROM metrics m LEFT JOIN jac USING (system))"


@query(SHOWN + """ SELECT '| System | Jaccard (Invariance) | Ground Truth Match | Clustering-for-All |' || chr(10) || '|--------|---------------------|-------------------|-------------------|' || chr(10)
|| string_agg('| ' || system || ' | ' || j || ' | ' || coalesce(printf('%.1f%%', gt * 100), 'n/a') || ' | ' || coalesce(printf('%.1f%%', cl * 100), 'n/a') || ' |', chr(10) ORDER BY system) AS summary FROM shown""")
def summary_markdown(spark, sf):
    return e.summary_table(judged_only(spark, sf))


@query(SHOWN + r""" SELECT '\begin{tabular}{lccc}' || chr(10) || '\toprule' || chr(10) || 'System & Jaccard & GT Match & Cluster-All \\' || chr(10) || '\midrule' || chr(10)
|| string_agg(system || ' & ' || j || ' & ' || coalesce(printf('%.0f\%%', gt * 100), 'n/a') || ' & ' || coalesce(printf('%.0f\%%', cl * 100), 'n/a') || ' \\', chr(10) ORDER BY system) || chr(10) || '\bottomrule' || chr(10) || '\end{tabular}' AS summary FROM shown""")
def summary_latex(spark, sf):
    return e.summary_table(judged_only(spark, sf), "latex")


@query(f"WITH {PROMPTS_SQL} SELECT prompt_id, coalesce(expected_geometry, 'unknown') AS expected_geometry, array_to_string(ground_truth, ', ') AS ground_truth FROM prompts")
def scenarios(spark, sf):
    return e.scenarios(prompts(spark))


CATEGORY = "CASE WHEN m IN ('leiden', 'clustering', 'k-means') THEN 'clustering' WHEN m IN ('slingshot', 'paga') THEN 'trajectory' WHEN m = 'cell_cycle_scoring' THEN 'cell_cycle' ELSE 'dim_reduction' END"


@query(WITH + f"SELECT doc_id, system, prompt_id, array_to_string(extracted_methods, ', ') AS methods, array_to_string(list_sort(list_distinct([{CATEGORY} FOR m IN extracted_methods])), ', ') AS categories FROM results WHERE success")
def method_recommendations(spark, sf):
    rows = results(spark, sf)
    return e.recommendations(rows.withColumn("prompt_id", F.struct("doc_id", "prompt_id"))).select("prompt_id.doc_id", "system", "prompt_id.prompt_id", "methods", "categories")


@query(WITH + "SELECT system, prompt_id, coalesce(expected_geometry, 'unknown') AS expected_geometry, CASE WHEN mentions_clustering THEN 'Yes' ELSE 'No' END AS recommends_clustering, CASE WHEN matches THEN 'Yes' ELSE 'No' END AS matches_ground_truth FROM judged WHERE success")
def failure_analysis(spark, sf):
    return e.failures(results(spark, sf), prompts(spark))


@query(WITH + "SELECT doc_id, c AS clustering_violation, y AS cell_cycle_violation, c OR y AS any_violation, c::INT + y::INT AS details FROM (SELECT doc_id, doc_id % 2 = 1 AND mentions_clustering AS c, doc_id % 3 = 0 AND mentions_cell_cycle AS y FROM results)")
def exclusion_violations(spark, sf):
    rows = results(spark, sf).withColumn("beta0", F.col("doc_id") % 2).withColumn("beta1", F.col("doc_id") % 3)
    return rows.select("doc_id", *violations()).withColumn("details", F.size("violation_details")).drop("violation_details")


@query(WITH + "SELECT metric, count(*) AS n, sum(value) AS total FROM (SELECT unnest(['method_count', 'mentions_clustering', 'mentions_trajectory', 'mentions_data_inspection', 'matches_ground_truth']) AS metric, unnest([len(extracted_methods)::DOUBLE, mentions_clustering::INT, mentions_trajectory::INT, mentions_data_inspection::INT, matches::INT]) AS value FROM judged WHERE success) WHERE value IS NOT NULL GROUP BY 1")
def prompt_metrics(spark, sf):
    long = e.prompt_metrics(results(spark, sf), prompts(spark))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("SELECT system, prompt_id, true AS success, 'leiden,pca,umap' AS methods FROM (SELECT DISTINCT source AS system FROM documents), (VALUES ('p0'), ('p1'), ('p2'), ('p3')) p(prompt_id)")
def mock_evaluation(spark, sf):
    systems = read_table(spark, sf, "documents").select(F.col("source").alias("system")).distinct()
    rows = loaders.evaluate_grid(prompts(spark).select("prompt_id"), systems)
    said = rows.withColumn("text", loaders.mock_response(["leiden", "umap", "pca"], F.col("prompt_id")))
    return extract(said).select("system", "prompt_id", loaders.valid_response(F.col("text")).alias("success"), F.array_join("extracted_methods", ",").alias("methods"))


@query(WITH + METRICS + " SELECT m.system, ok AS prompts_evaluated, bad AS prompts_failed, round(cl, 6) AS clustering_for_all_rate, r.methods FROM metrics m JOIN (SELECT system, sum(len(extracted_methods))::BIGINT AS methods FROM results GROUP BY 1) r USING (system)")
def saved_results(spark, sf):
    """Results written as JSON with their metrics and page, and both read back."""
    folder, rows = shared_path(spark, "results"), results(spark, sf).drop("text")
    sinks.save_results(rows, prompts(spark), folder, "evaluation", "e1", "2024-01-01T00:00:00")
    back = sinks.read_results(spark, folder, rows.schema).groupBy("system").agg(F.sum(F.size("extracted_methods")).alias("methods"))
    metrics = spark.read.schema("system string, prompts_evaluated long, prompts_failed long, clustering_for_all_rate double").json(f"{folder}/metrics")
    return metrics.withColumn("clustering_for_all_rate", F.round("clustering_for_all_rate", 6)).join(back, "system")


@query(SHOWN + " SELECT system, system || ':' || chr(10) || '  Jaccard Similarity: ' || j || ' (all successful pairs; not an optimization objective)' || chr(10) || '  Ground Truth Match: ' || coalesce(printf('%.1f%%', gt * 100), 'n/a') || ' (higher is better)' || chr(10) || '  Clustering-for-All: ' || coalesce(printf('%.1f%%', cl * 100), 'n/a') || ' (lower is better)' AS text FROM shown")
def printed_summary(spark, sf):
    return sinks.printed(judged_only(spark, sf))
