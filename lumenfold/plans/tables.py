"""Queries of the table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text
from lumenfold.operators import measurements as m
from lumenfold.operators import tabular as t
from lumenfold.session import read_table, shared_path
from lumenfold.sources import loaders, sinks

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _sides(spark, sf):
    """Customers by nation and segment against suppliers, with missing keys on both sides and a shared column."""
    left = read_table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    right = read_table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("s_acctbal"), 2).alias("best"))
    return left.select(F.nullif("c_nationkey", F.lit(3)).alias("nation"), "n", "balance"), right.select(F.nullif("s_nationkey", F.lit(3)).alias("nation"), "n", "best")


SIDES = (
    "a AS (SELECT nullif(c_nationkey, 3) AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_nationkey), "
    "b AS (SELECT nullif(s_nationkey, 3) AS nation, count(*) AS n, round(max(s_acctbal), 2) AS best FROM supplier GROUP BY s_nationkey)"
)


@query(f"WITH {SIDES} SELECT a.nation, a.n AS n_x, b.n AS n_y, balance, best FROM a JOIN b ON a.nation IS NOT DISTINCT FROM b.nation")
def merge_inner(spark, sf):
    return t.merge(_sides(spark, sf), "inner_join", "nation")


@query(f"WITH {SIDES} SELECT coalesce(a.nation, b.nation) AS nation, a.n AS n_x, b.n AS n_y, balance, best FROM a FULL JOIN b ON a.nation IS NOT DISTINCT FROM b.nation")
def merge_outer(spark, sf):
    return t.merge(_sides(spark, sf), "outer_join", ["nation"])


@query(f"WITH {SIDES} SELECT a.nation, a.n AS n_x, b.n AS n_y, balance, best FROM a JOIN b ON a.nation IS NOT DISTINCT FROM b.nation")
def merge_auto_key(spark, sf):
    return t.merge(_sides(spark, sf), "inner_join")


@query(f"WITH {SIDES} SELECT nation, n, balance, NULL AS best FROM a UNION ALL SELECT nation, n, NULL, best FROM b")
def merge_concat(spark, sf):
    return t.merge(_sides(spark, sf), "concat")


@query("SELECT n_nationkey AS nation, n_name, r_name, c.customers FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def merge_fold(spark, sf):
    nation = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"))
    region = read_table(spark, sf, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    customers = read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    return t.merge([t.merge([nation, region], "inner_join", "region"), customers], "inner_join", "nation").select("nation", "n_name", "r_name", "customers")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_equals(spark, sf):
    return t.filter_by(read_table(spark, sf, "orders"), "o_orderpriority", "equals", "1-URGENT").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_greater_than(spark, sf):
    return t.filter_by(read_table(spark, sf, "lineitem"), "l_quantity", "greater_than", 45).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def filter_less_than(spark, sf):
    return t.filter_by(read_table(spark, sf, "customer"), "c_acctbal", "less_than", 0).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^[A-Z].*[AEae].?[A-Za-z]$')")
def filter_contains(spark, sf):
    return t.filter_by(read_table(spark, sf, "part"), "p_type", "contains", "^[A-Z].*[AEae].?[A-Za-z]$").select("p_partkey", "p_type")


def _scores(df, **_):
    return df.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("score"))


SCORED = "scored AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS score FROM customer)"


@query(f"WITH {SCORED} SELECT c_custkey, score FROM scored WHERE score >= 100")
def threshold(spark, sf):
    return t.above(_scores(read_table(spark, sf, "customer")), 100.0)


@query(f"WITH {SCORED} SELECT c_custkey, score FROM scored WHERE score >= 100 ORDER BY score DESC, c_custkey LIMIT 50")
def score_and_rank(spark, sf):
    return t.score_and_rank(read_table(spark, sf, "customer"), _scores, 100.0, 50, ["c_custkey"])


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25")
def rank_top_n(spark, sf):
    return t.rank_by(read_table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", top=25, tiebreak=["p_partkey"])


@query(f"WITH {SCORED} SELECT c_custkey, score FROM scored ORDER BY score NULLS LAST, c_custkey LIMIT 40")
def rank_ascending(spark, sf):
    return t.rank_by(_scores(read_table(spark, sf, "customer")), "score", ascending=True, top=40, tiebreak=["c_custkey"]).withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


UNIT = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"


@query(f"SELECT c_custkey, {UNIT.format("'7:' || c_custkey")} AS score, true AS score_simulated FROM customer")
def random_scores(spark, sf):
    return t.simulated_scores(read_table(spark, sf, "customer").select("c_custkey"), "c_custkey", 7)


def _shown(df):
    return df.withColumns({c: F.col(c).cast("string") for c in ("discount_flag", "quantity_flag")})


def _flags(df, most):
    return df.select("l_orderkey", "l_linenumber", (F.col("l_discount") > most).alias("discount_flag"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity") > 40).alias("quantity_flag"))


FLAGS = "f AS (SELECT l_orderkey, l_linenumber, l_discount > 0.08 AS discount_flag, CASE WHEN l_linenumber <> 2 THEN l_quantity > 40 END AS quantity_flag FROM lineitem)"


@query(f"WITH {FLAGS} SELECT l_orderkey, l_linenumber, discount_flag::VARCHAR AS discount_flag, quantity_flag::VARCHAR AS quantity_flag FROM f WHERE NOT (coalesce(discount_flag, false) OR coalesce(quantity_flag, false))")
def validate_strict_passed(spark, sf):
    return _shown(t.validate(read_table(spark, sf, "lineitem"), _flags, "strict", most=0.08)[0])


@query(f"WITH {FLAGS} SELECT l_orderkey, l_linenumber, discount_flag::VARCHAR AS discount_flag, quantity_flag::VARCHAR AS quantity_flag FROM f WHERE coalesce(discount_flag, false) OR coalesce(quantity_flag, false)")
def validate_strict_flagged(spark, sf):
    return _shown(t.validate(read_table(spark, sf, "lineitem"), _flags, "strict", most=0.08)[1])


@query(f"WITH {FLAGS} SELECT l_orderkey, l_linenumber, discount_flag::VARCHAR AS discount_flag, quantity_flag::VARCHAR AS quantity_flag FROM f")
def validate_flag(spark, sf):
    return _shown(t.validate(read_table(spark, sf, "lineitem"), _flags, "flag", most=0.08)[0])


@query("SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice * 0.9), 2) AS discounted FROM orders GROUP BY 1")
def transform_frame(spark, sf):
    def discounted(df, rate):
        return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o_totalprice") * rate), 2).alias("discounted"))

    return t.transform(read_table(spark, sf, "orders"), discounted, rate=0.9)


@query("SELECT vec_id, len(embedding) > 0 AND NOT list_has_any([isfinite(x) FOR x IN embedding], [false]) AS finite FROM embeddings")
def finite_arrays(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", t.finite("embedding").alias("finite"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing success' WHEN length(text) < 400 THEN 'missing summary' WHEN doc_id % 11 = 0 THEN 'missing output_files' END AS violation FROM documents")
def contract_violations(spark, sf):
    """Results whose summary is a text of the corpus; short ones count as none."""
    d = F.col("doc_id")
    rows = read_table(spark, sf, "documents").select("doc_id", F.when(d % 5 != 0, F.lit(True)).alias("success"), F.when(F.length("text") >= 400, F.col("text")).alias("summary"), F.when(d % 11 != 0, F.create_map(F.lit("a"), F.lit("b"))).alias("output_files"))
    return rows.select("doc_id", t.contract_violation(rows).alias("violation"))


@query("SELECT * FROM (VALUES ('a')) d(dataset), (VALUES (5), (10), (15)) k(neighbors), (VALUES ('pca'), ('umap'), ('phate'), ('tsne')) m(method), (VALUES (0.1), (0.5), (1.0)) s(spread)")
def sweep_grid(spark, sf):
    return t.grid(spark, dataset=["a"], neighbors=[5, 10, 15], method=["pca", "umap", "phate", "tsne"], spread=[0.1, 0.5, 1.0])


@query("SELECT 'trust__k_' || k || '__p_' || p AS name, k, p, true AS scaled FROM (VALUES (5), (15), (25)) a(k), (VALUES (1), (2)) b(p)")
def metric_variants(spark, sf):
    rows = [(n, o["k"], o["p"], o["scaled"]) for n, o in loaders.variants("trust", {"k": [5, 15, 25], "p": [1, 2], "scaled": True})]
    return spark.createDataFrame(rows, "name string, k int, p int, scaled boolean")


ENTRIES = [("a", "x/b.yaml", "core"), ("a", "y/a.yaml", "core"), ("b", "x/c.yaml", "ext"), ("b", "w/d.yaml", "core"), ("c", "c.yml", "ext")]


@query(f"SELECT name, file, source FROM (VALUES {', '.join(map(str, ENTRIES))}) v(name, file, source) QUALIFY row_number() OVER (PARTITION BY name ORDER BY regexp_extract(file, '([^/]+)\\.ya?ml$', 1) <> name, file) = 1")
def registry_dedupe(spark, sf):
    return t.dedupe_registry(spark.createDataFrame(ENTRIES, "name string, file string, source string"))


@query("SELECT doc_id, trim(list_extract(string_split(coalesce(text, '') || ' #### ' || (doc_id % 97) || ' #### ' || (doc_id * 3) || ' ' || source || ' ', '####'), -1)) AS answer FROM documents")
def dataset_answers(spark, sf):
    """Whole texts as the working before two marks; what follows the last one is the answer."""
    worked = F.concat(F.coalesce("text", F.lit("")), F.lit(" #### "), (F.col("doc_id") % 97).cast("string"), F.lit(" #### "), (F.col("doc_id") * 3).cast("string"), F.lit(" "), F.col("source"), F.lit(" "))
    return read_table(spark, sf, "documents").select("doc_id", loaders.answer(worked).alias("answer"))


@query("SELECT 'gsm8k_train_' || (row_number() OVER (ORDER BY item_id) - 1) AS task_id, text AS prompt, (item_id * 3)::VARCHAR AS expected_answer, 'math' AS domain, 'arithmetic' AS logic_type FROM benchmark ORDER BY item_id LIMIT 25")
def dataset_tasks(spark, sf):
    rows = read_table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), F.concat(F.lit("so it is #### "), (F.col("item_id") * 3).cast("string")).alias("answer"))
    return loaders.tasks(rows, "item_id", 25)


MOCKED = f"mocked AS (SELECT item_id::VARCHAR AS prompt_id, text, {UNIT.format("'3:' || item_id")} < 0.3 AS failed FROM benchmark)"


@query(f"WITH {MOCKED} SELECT 'mock' AS system, prompt_id, NOT failed AS success, CASE WHEN failed THEN 'Simulated failure (mock adapter)' ELSE 'Mock response generated (' || (391 + length(length(text)::VARCHAR)) || ' chars)' END AS summary, CASE WHEN failed THEN 'simulated failure' END AS error, CASE WHEN NOT failed THEN length(text) END AS prompt_length FROM mocked")
def mock_failures(spark, sf):
    """A mock system on the benchmark's items, three of ten calls failing; the response tells the prompt's length."""
    rows = loaders.mock_results(read_table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), "text"), fail_rate=0.3, seed=3)
    told = F.regexp_extract("raw_response", r"prompt length: (\d+) chars", 1)
    return rows.select("system", "prompt_id", "success", "summary", "error", F.when(F.col("success"), told.cast("long")).alias("prompt_length"))


@query("SELECT source AS system, doc_id::VARCHAR AS prompt_id, text AS raw_response FROM documents WHERE text IS NOT NULL")
def response_files(spark, sf):
    """Responses written as text files by system and prompt, and read back from them."""
    folder = shared_path(spark, "responses")
    rows = read_table(spark, sf, "documents").select(F.col("source").alias("system"), (F.col("doc_id") % 4).cast("string").alias("prompt_id"), F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("raw_response"))
    sinks.save_responses(rows, folder)
    body = F.split("raw_response", "\n", 2)
    return sinks.read_responses(spark, folder).select("system", F.get(body, F.lit(0)).alias("prompt_id"), F.get(body, F.lit(1)).alias("raw_response"))


@query("SELECT vec_id, label, e.label * 2 AS bonus, len(embedding) AS width, label % 3 AS trust FROM embeddings e")
def merged_outputs(spark, sf):
    """Embedding outputs with what another step adds; its embeddings don't replace the first one's."""
    e = read_table(spark, sf, "embeddings")
    base = e.select("vec_id", F.col("embedding").alias("embeddings"), "label", F.lit(0).alias("trust"))
    more = e.select("vec_id", F.array(F.lit(0.0)).alias("embeddings"), (F.col("label") % 3).alias("trust"), (F.col("label") * 2).alias("bonus"))
    return m.merged_outputs(base, more, "vec_id").select("vec_id", "label", "bonus", F.size("embeddings").cast("long").alias("width"), "trust")


@query("SELECT vec_id, len(embedding) AS width, label / 10.0 AS trust, 'x' AS free FROM embeddings")
def geometric_features(spark, sf):
    e = read_table(spark, sf, "embeddings")
    outputs = e.select("vec_id", F.col("embedding").alias("embeddings"), "label", F.struct((F.col("label") / F.lit(10.0)).alias("trust")).alias("scores"), F.lit("x").alias("free"))
    return m.geometric_features(outputs, "vec_id").select("vec_id", F.size("embeddings").cast("long").alias("width"), "geometric_metrics.trust", "free")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' k-Means__2.' || p_brand)), '[_\\-\\s]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS k FROM part")
def normalise_names(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", text.method_key(F.concat("p_name", F.lit(" k-Means__2."), "p_brand")).alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS text FROM documents")
def truncate_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", text.truncated("text", 60).alias("text"))


@query("SELECT event_id, CASE WHEN json_valid(p) THEN json_extract_string(p, '$.k')::BIGINT END AS k, CASE WHEN NOT json_valid(p) THEN 'invalid JSON' END AS error FROM (SELECT event_id, CASE WHEN event_id % 3 = 1 THEN props[:length(props) - 1] ELSE props END AS p FROM events)")
def parse_json(spark, sf):
    """The events' properties, a third of them cut short."""
    p = F.when(F.col("event_id") % 3 == 1, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    value, error = text.parsed("p", "k bigint")
    return read_table(spark, sf, "events").select("event_id", p.alias("p")).select("event_id", value["k"].alias("k"), error.alias("error"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def load_filter_aggregate(spark, sf):
    rows = loaders.load_source(spark, {"loader": "tables:parquet", "params": {"path": f"{sf}/lineitem.parquet", "columns": ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]}})
    rows = rows.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
