"""How the driver's tables stand in for prompts, responses, states and traces, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.vocabulary import INSPECTION, METHODS, patterns
from lumenfold.session import read_table, spread

PROMPTS = (
    ("p0", "discrete_clusters", ("leiden", "louvain", "kmeans", "spectral_clustering", "phenograph"), ("trajectory_inference", "pseudotime", "monocle", "slingshot")),
    ("p1", "branching_trajectory", ("slingshot", "monocle3", "paga", "cellrank", "diffusion_pseudotime", "palantir"), ("clustering", "cluster_analysis", "leiden", "louvain", "kmeans")),
    ("p2", "continuous_manifold", ("phate", "diffusion_map", "umap", "isomap", "force_atlas"), ("clustering", "cluster_analysis", "discrete_groups", "leiden", "louvain")),
    ("p3", None, (), ("leiden",)),
)
#: Responses and the methods that the rules leave of them: (text, methods, clustering, trajectory, cell cycle, inspection).
RESPONSES = (
    ("Use UMAP and Leiden.", ("leiden", "umap"), True, False, False, False),
    ("Avoid Leiden. Use PHATE.", ("phate",), False, False, False, False),
    ("UMAP and Leiden are not appropriate.", (), False, False, False, False),
    ("I recommend slingshot rather than Louvain.", ("slingshot",), False, True, False, False),
    ("First look at the data; then cluster the cells.", ("clustering",), True, False, False, True),
    ("Do not use **UMAP**, but PAGA is fine.", ("paga",), False, True, False, False),
    ("Apply cell cycle scoring and k-means.", ("cell_cycle_scoring", "k-means"), True, False, True, False),
    ("Nothing to add.", (), False, False, False, False),
    ("Monocle3 would be wrong. Diffusion map is useful.", ("diffusion_map",), False, False, False, False),
    ("Don’t recommend t-SNE; PCA should be used first.", ("pca",), False, False, False, False),
)


def prompts(spark: SparkSession) -> DataFrame:
    rows = [(p, g, list(t), list(f)) for p, g, t, f in PROMPTS]
    return spark.createDataFrame(rows, "prompt_id string, expected_geometry string, ground_truth array<string>, failure array<string>")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response a document: its whole text and a recommendation after it. System is its source, the prompt and the
    recommendation go by doc_id, one in 13 calls fails."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    texts = F.array(*(F.lit(r[0]) for r in RESPONSES))
    return d.select(
        "doc_id", F.concat(F.lit("p"), F.expr("(doc_id div 7) % 4").cast("string")).alias("prompt_id"), F.col("source").alias("system"), F.col("doc_id").alias("pos"),
        (F.col("doc_id") % 13 != 5).alias("success"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.get(texts, (F.col("doc_id") % 10).cast("int"))).alias("text"),
    )


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"


PROMPTS_SQL = "prompts AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {repr(g) if g else 'NULL'}, {_list(t)}, {_list(f)})" for p, g, t, f in PROMPTS) + ") v(prompt_id, expected_geometry, ground_truth, failure))"
def found_sql(text: str) -> str:
    """(category, method) of the names and phrases in a text, as a list without order, by DuckDB's regular expressions."""
    tests = ", ".join(f"CASE WHEN regexp_matches({text}, '{p.removeprefix('(?U)')}') THEN {{'c': '{c}', 'm': '{m}'}} END" for c, m, p, _ in patterns())
    return f"[x FOR x IN [{tests}] IF x IS NOT NULL]"


RESULTS_SQL = (
    "said AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}', {_list(m)}, {c}, {j}, {y}, {n})" for i, (t, m, c, j, y, n) in enumerate(RESPONSES)) + ") v(k, advice, ms, mc, mt, my, mi)), "
    f"own AS (SELECT doc_id, source, text, {found_sql('lower(coalesce(text, chr(32)))')} AS f, regexp_matches(lower(coalesce(text, '')), '" + "|".join(INSPECTION) + "') AS looked FROM documents), "
    "results AS (SELECT doc_id, 'p' || ((doc_id // 7) % 4) AS prompt_id, source AS system, doc_id AS pos, doc_id % 13 <> 5 AS success, list_sort(list_distinct(list_concat(ms, [x.m FOR x IN f]))) AS extracted_methods, "
    "mc OR list_contains([x.c FOR x IN f], 'clustering') AS mentions_clustering, mt OR list_contains([x.c FOR x IN f], 'trajectory') AS mentions_trajectory, my OR list_contains([x.c FOR x IN f], 'cell_cycle') AS mentions_cell_cycle, mi OR looked AS mentions_data_inspection "
    "FROM own JOIN said ON doc_id % 10 = k)"
)
#: Normalised names, as the matching rule compares them.
KEYS_SQL = "[regexp_replace(regexp_replace(lower(trim(x)), '[_\\-\\s]+', '_', 'g'), '[^a-z0-9_]', '', 'g') FOR x IN {}]"
JUDGED_SQL = (
    "judged AS (SELECT *, list_sort(list_intersect(own, want)) AS hits, list_sort(list_intersect(own, bad)) AS fails, CASE WHEN len(want) > 0 THEN len(list_intersect(own, want)) > 0 AND len(list_intersect(own, bad)) = 0 END AS matches FROM ("
    f"SELECT r.*, p.expected_geometry, list_distinct({KEYS_SQL.format('r.extracted_methods')}) AS own, list_distinct({KEYS_SQL.format('p.ground_truth')}) AS want, list_distinct({KEYS_SQL.format('p.failure')}) AS bad FROM results r LEFT JOIN prompts p USING (prompt_id)))"
)


#: All names, in order of category.
NAMES = [m for ms in METHODS.values() for m in ms]


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token states: a trace a label, tokens in order of vec_id, one layer."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("trace_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("token_idx"), F.lit(0).alias("layer"), F.col("embedding").alias("state"))


STATES_SQL = "states AS (SELECT label AS trace_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS token_idx, 0 AS layer, embedding::DOUBLE[] AS state FROM embeddings)"
