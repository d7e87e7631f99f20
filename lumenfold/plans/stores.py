"""Queries over sources that are rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.sources import lateral

QUERIES, ORACLES = {}, {}


def loaded_sources(spark, sf):
    """Three tables as a table of sources, read in parallel by a lateral join; one has none of the columns but a name."""
    names = spark.createDataFrame([("region",), ("nation",), ("supplier",)], "name string").repartition(3)
    path = F.concat(F.lit(f"{sf}/"), "name", F.lit(".parquet"))
    sources = names.select("name", F.lit("files:dataset").alias("loader"), F.to_json(F.struct(path.alias("path"))).alias("params"))
    return lateral.load_all(sources, "r_regionkey bigint, r_name string, n_nationkey bigint, n_name string, s_name string")


QUERIES["loaded_sources"] = loaded_sources
ORACLES["loaded_sources"] = """SELECT 'region' AS source, r_regionkey::BIGINT AS r_regionkey, r_name, NULL::BIGINT AS n_nationkey, NULL::VARCHAR AS n_name, NULL::VARCHAR AS s_name FROM region
UNION ALL SELECT 'nation', NULL, NULL, n_nationkey::BIGINT, n_name, NULL FROM nation UNION ALL SELECT 'supplier', NULL, NULL, NULL, NULL, s_name FROM supplier"""
