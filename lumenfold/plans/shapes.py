"""Queries of metrics that ship with the library, on the vectors of a whole table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from lumenfold.operators import diffusion, embedding, geometry, neighbour_maps, tangent
from lumenfold.operators.neighbours import neighbour_lists, neighbours
from lumenfold.session import clean_cut as cut
from lumenfold.session import read_table
from lumenfold.sources import metrics, registry

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("state"))


def _sql(name: str, source: str, k: int, parts: int) -> str:
    """CTEs of a set of vectors: {name}_pr, its participation ratio; {name}_lid; {name}_parts, components of the graph of `parts` neighbours."""
    return (
        f"{name} AS ({source}), {name}_c AS (SELECT i, j, covar_samp(state[i], state[j]) AS c FROM {name}, generate_series(1, 64) a(i), generate_series(1, 64) b(j) WHERE i <= len(state) AND j <= len(state) GROUP BY 1, 2), "
        f"{name}_pr AS (SELECT power(sum(c) FILTER (i = j), 2) / sum(c * c) AS x FROM {name}_c), "
        f"{name}_near AS (SELECT a.id, b.id AS other, list_distance(a.state, b.state) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.state, b.state), b.id) AS rank FROM {name} a JOIN {name} b ON a.id <> b.id), "
        f"{name}_lid AS (SELECT avg(x) AS x FROM (SELECT count(*) FILTER (rank < {k}) / (count(*) FILTER (rank < {k}) * ln(max(d) FILTER (rank = {k})) - sum(ln(d)) FILTER (rank < {k})) AS x FROM {name}_near WHERE rank <= {k} GROUP BY id)), "
        f"{name}_links AS (SELECT id AS a, other AS b FROM {name}_near WHERE rank <= {parts} UNION SELECT other, id FROM {name}_near WHERE rank <= {parts}), "
        f"{name}_reach AS (SELECT id AS a, id AS b FROM {name} UNION SELECT r.a, l.b FROM {name}_reach r JOIN {name}_links l ON l.a = r.b), {name}_parts AS (SELECT count(DISTINCT low)::DOUBLE AS x FROM (SELECT a, min(b) AS low FROM {name}_reach GROUP BY 1))"
    )


RAW = "SELECT vec_id AS id, embedding::DOUBLE[] AS state FROM embeddings"


@query(f"WITH RECURSIVE {_sql('v', RAW, 3, 2)}, u AS (SELECT [x / sqrt(list_inner_product(state, state)) FOR x IN state] AS s FROM v), m AS (SELECT avg(s[i]) AS m FROM u, generate_series(1, 64) a(i) GROUP BY i), "
       "five AS (SELECT avg(x) AS x FROM (SELECT 4 / (4 * ln(max(d)) - sum(ln(d)) FILTER (rank < 5)) AS x FROM v_near WHERE rank <= 5 GROUP BY id)) "
       "SELECT 'participation_ratio' AS metric, round(x, 4) AS score FROM v_pr UNION ALL SELECT 'local_intrinsic_dimensionality__k_3', round(x, 4) FROM v_lid UNION ALL SELECT 'local_intrinsic_dimensionality__k_5', round(x, 4) FROM five "
       "UNION ALL SELECT 'connected_components', x FROM v_parts UNION ALL SELECT 'anisotropy', round(sum(m * m), 4) FROM m")  # fmt: skip
def cached_metrics(spark, sf):
    """Metrics set up once by name, one of them in two variants, and run on all vectors."""
    ready = registry.set_up(metrics.catalogue(), ["participation_ratio", {"local_intrinsic_dimensionality": {"k": [3, 5]}}, {"connected_components": {"k": 2}}, "anisotropy"])
    return registry.execute(spark, ready, embedding=vectors(spark, sf)).select("metric", F.round("score", 4).alias("score"))


@query(f"WITH RECURSIVE {_sql('a', RAW, 5, 2)}, {_sql('b', 'SELECT id, [-x / 2 FOR x IN state] AS state FROM a', 5, 2)}, {_sql('c', 'SELECT id, state[1:8] AS state FROM b', 5, 2)}, "
       "s AS (" + " UNION ALL ".join(f"SELECT {step} AS step, 'beta_0' AS metric, x AS value FROM {n}_parts UNION ALL SELECT {step}, 'participation_ratio', round(x, 4) FROM {n}_pr UNION ALL SELECT {step}, 'local_intrinsic_dim', round(x, 4) FROM {n}_lid" for step, n in enumerate("abc")) + ") "
       "SELECT step, metric, 'measured' AS status, value FROM s UNION ALL SELECT DISTINCT step, 'beta_1', 'not_requested', NULL::DOUBLE FROM s")  # fmt: skip
def measured_sequence(spark, sf):
    """A trajectory of two transforms, measured by components, participation ratio and intrinsic dimension at each step."""
    known = {"beta_0": partial(metrics.connected_components, k=2), "beta_1": None, "participation_ratio": metrics.participation_ratio, "local_intrinsic_dim": partial(metrics.local_intrinsic_dimensionality, k=5)}
    turned = lambda d: d.withColumn("state", F.transform("state", lambda x: -x / 2))
    few = lambda d: d.withColumn("state", F.slice("state", 1, 8))
    rows = geometry.trajectory(vectors(spark, sf), [turned, few], known, ["beta_0", "participation_ratio", "local_intrinsic_dim"])
    return rows.select("step", "metric", "status", F.round("value", 4).alias("value"))


@query()
def tangent_space(spark, sf):
    """Of each label's vectors: the dimension of their neighbourhoods and the angle between neighbours' tangent planes."""
    rows = read_table(spark, sf, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("state"))
    return tangent.tangent_space(rows, 10, 2).select("group", "n", F.round("dimension", 6).alias("dimension"), F.round("angle", 6).alias("angle"))


def _labelled(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("state"))


@query("WITH v AS (SELECT label AS g, vec_id AS id, embedding::DOUBLE[] AS state FROM embeddings), near AS (SELECT a.g, a.id, b.id AS other, list_distance(a.state, b.state) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.state, b.state), b.id) AS rank FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id), "
       "wide AS (SELECT *, max(d) FILTER (rank = 5) OVER (PARTITION BY id) AS e FROM near WHERE rank <= 15), one AS (SELECT g, id AS a, other AS b, exp(-power(d / e, 10)) AS w FROM wide WHERE exp(-power(d / e, 10)) >= 1e-4), "
       "kernel AS (SELECT g, a, b, sum(w) / 2 AS w FROM (SELECT * FROM one UNION ALL SELECT g, b, a, w FROM one) GROUP BY 1, 2, 3 UNION ALL SELECT g, id, id, 1.0 FROM v), p AS (SELECT *, w / sum(w) OVER (PARTITION BY a) AS p FROM kernel) "
       "SELECT x.g AS \"group\", x.a, y.b, round(sum(x.p * y.p), 6) AS p FROM p x JOIN p y ON x.b = y.a AND x.g = y.g GROUP BY 1, 2, 3")  # fmt: skip
def diffusion_steps(spark, sf):
    """Two steps of the walk over each label's graph of neighbours."""
    points = _labelled(spark, sf)
    step = cut(diffusion.markov(diffusion.with_selves(diffusion.decaying(neighbours(points, 15), 5, 10.0), points)))
    return diffusion.product(step, step).withColumn("p", F.round("p", 6))


@query()
def phate(spark, sf):
    """Each label's vectors in two dimensions."""
    drawn = diffusion.phate(_labelled(spark, sf), 5, 10.0, 8)
    return drawn.select("group", "id", F.round(F.get("projected", F.lit(0)), 3).alias("x"), F.round(F.get("projected", F.lit(1)), 3).alias("y"))


@query()
def fuzzy_links(spark, sf):
    """UMAP's weights over each label's graph of neighbours."""
    return embedding.fuzzy_links(neighbour_lists(_labelled(spark, sf), 10)).withColumn("w", F.round("w", 4))


@query()
def umap(spark, sf):
    """All vectors in two dimensions."""
    drawn = embedding.umap(vectors(spark, sf), 15, 4, 25)
    return drawn.select("id", F.round(F.get("projected", F.lit(0)), 3).alias("x"), F.round(F.get("projected", F.lit(1)), 3).alias("y"))


@query()
def tsne_affinities(spark, sf):
    """t-SNE's affinities over the graph of all vectors; all of them sum up to 1."""
    points = vectors(spark, sf).withColumn("group", F.lit(0))
    return neighbour_maps.affinities(neighbour_lists(points, 30), 10.0).withColumn("p", F.round("p", 8))
