"""URL filters: rules first, and for other pages the reputation of their host by empirical Bayes.

A host's labelled pages are bad or not. Its share of bad ones has a beta prior whose mean is that of its registered
domain, whose own prior has the mean of its suffix, and a suffix's that of all pages. How strongly a level pulls is
learnt from all nodes of that level: the pages of a node scatter about its parent's mean more than single draws would,
and the excess gives the beta-binomial's precision by moments. So a host with few labels takes over its domain's share,
one with many keeps its own. A host is blocked where the lower bound of its posterior share of bad pages reaches a
limit; the bound is taken on the arcsine scale, where the spread depends on the number of pages alone.

Counts by host are summed in each task before they are shuffled, so a host with most of the pages costs no more than
others. Only blocked hosts go back to the pages, which are joined with them last.

A null url, or one without ://, has an empty host and path; the empty host has its own reputation. Pages without
label, or with a null page_id, count for nothing but are judged. Several labels of a page are averaged, a tie counts as
good. Repeated pages each count and are each returned. A rule fits its host and all subdomains where the path starts
with its own; of several the longest wins, of equally long ones the one listed first. Without labels nothing but rules
block. An empty table gives no rows. Ports and user names belong to the host, but not to its domain; numeric hosts are
their own domains. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.session import cut, read_table, shared_path

#: The contract's rules, in its order.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Second-level labels under which domains are registered, of suffixes with two letters.
SECOND = ("ac", "co", "com", "edu", "gov", "gob", "ne", "net", "or", "org")
#: A host is blocked where this share of its pages is bad, with normal deviation SURE of certainty.
LIMIT, SURE = 0.3, 1.645
#: Bounds of the correlation of a node's pages: a prior counts for 199 pages at most, and for a thousandth of one at least.
LEAST_RHO, MOST_RHO = 0.005, 0.999
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = "CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END"


def with_parts(pages: DataFrame) -> DataFrame:
    """pages with host and path after their own columns."""
    after = F.coalesce(F.expr(AFTER), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER), "path": F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)})


def rule_of(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, _, begin = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{begin}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    bare = F.regexp_replace(host, r"^.*@|:\d*$", "")
    numeric = bare.rlike(r"^[0-9.]*$|^\[")
    suffix = F.regexp_extract(bare, rf"^(?:.*\.)?((?:(?:{'|'.join(SECOND)})\.[a-z][a-z]|[^.]*))$", 1)
    domain = F.regexp_extract(bare, rf"((?:[^.]*\.)?(?:(?:{'|'.join(SECOND)})\.[a-z][a-z]|[^.]*))$", 1)
    return F.when(numeric, bare).otherwise(domain), F.when(numeric, "").otherwise(suffix)


def shrunk(nodes: DataFrame, mean: str) -> DataFrame:
    """nodes with n pages, x bad ones and a parent's mean -> with `k`, the precision of their level's prior."""
    m, n, x = F.col(mean), F.col("n"), F.col("x")
    one = m * (1 - m)
    # A node's scatter grows with the square of its pages; divided by their number, no large node tells alone.
    spread, most = F.sum(F.when(n > 1, ((x - n * m) * (x - n * m) - n * one) / (n - 1))), F.sum(F.when(n > 1, n * one))
    rho = F.least(F.greatest(F.coalesce(spread / F.nullif(most, F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    return nodes.withColumn("k", F.lit(nodes.agg(1 / rho - 1).first()[0]))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """pages: page_id, host; outcomes: page_id, bad. Of each host: host, n, x, share and bound, its posterior mean and
    its lower bound."""
    told = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg((F.avg(F.col("bad").cast("double")) > 0.5).cast("long").alias("bad"))
    domain, suffix = domain_of(F.col("host"))
    hosts = pages.select("page_id", "host").join(told, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    hosts = cut(hosts.withColumns({"domain": domain, "suffix": suffix}))
    add = (F.sum("n").alias("n"), F.sum("x").alias("x"))
    domains = cut(hosts.groupBy("domain", "suffix").agg(*add))
    suffixes = domains.groupBy("suffix").agg(*add)
    mean = domains.agg(F.coalesce(F.sum("x") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0))).first()[0]
    posterior = (F.col("x") + F.col("k") * F.col("parent")) / (F.col("n") + F.col("k"))
    top = shrunk(cut(suffixes.withColumn("parent", F.lit(mean))), "parent").select("suffix", posterior.alias("parent"))
    middle = shrunk(cut(domains.join(top, "suffix")), "parent").select("domain", "suffix", posterior.alias("parent"))
    low = shrunk(cut(hosts.join(middle, ["domain", "suffix"])), "parent")
    share, pages_seen = posterior, F.col("n") + F.col("k")
    angle = F.asin(F.sqrt(F.least(share, F.lit(1.0)))) - SURE / (2 * F.sqrt(pages_seen + 1))
    return low.select("host", "n", "x", share.alias("share"), F.pow(F.sin(F.greatest(angle, F.lit(0.0))), 2).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """pages: page_id, url; outcomes: page_id, bad. page_id, host, path, rule and verdict of each page."""
    spark = pages.sparkSession
    parted = with_parts(pages.select("page_id", "url"))
    folder = shared_path(spark, "blocked")
    reputations(parted, outcomes).where(F.col("bound") >= limit).select(F.col("host").alias("blocked")).write.parquet(folder)
    # Read from a file, the hosts have a known size, so the join broadcasts them exactly where they are few.
    blocked = spark.read.parquet(folder)
    ruled = parted.withColumn("r", rule_of(rules, F.col("host"), F.col("path")))
    found = ruled.join(blocked, F.col("host") == F.col("blocked"), "left")
    own = F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"))


def _level(nodes: str, parent: str) -> str:
    """SQL: the nodes with their parents' mean, their level's precision and posterior mean."""
    rho = f"least(greatest(coalesce(sum(CASE WHEN n > 1 THEN ((x - n * {parent}) * (x - n * {parent}) - n * {parent} * (1 - {parent})) / (n - 1) END) / nullif(sum(CASE WHEN n > 1 THEN n * {parent} * (1 - {parent}) END), 0), 0), {LEAST_RHO}), {MOST_RHO})"
    return f"(SELECT *, (x + k * {parent}) / (n + k) AS share FROM {nodes}, (SELECT 1 / {rho} - 1 AS k FROM {nodes}))"


_SECOND = "|".join(SECOND)
SQL = rf"""WITH a AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
p AS (SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
told AS (SELECT doc_id AS page_id, (avg(1 - quality) > 0.5)::BIGINT AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, regexp_replace(host, '^.*@|:\d*$', '', 'g') AS bare, count(bad) AS n, coalesce(sum(bad), 0) AS x FROM p LEFT JOIN told USING (page_id) GROUP BY 1, 2),
hosts AS (SELECT host, n, x, CASE WHEN regexp_matches(bare, '^[0-9.]*$|^\[') THEN bare ELSE regexp_extract(bare, '((?:[^.]*\.)?(?:(?:{_SECOND})\.[a-z][a-z]|[^.]*))$', 1) END AS domain,
  CASE WHEN regexp_matches(bare, '^[0-9.]*$|^\[') THEN '' ELSE regexp_extract(bare, '^(?:.*\.)?((?:(?:{_SECOND})\.[a-z][a-z]|[^.]*))$', 1) END AS suffix FROM h0),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY 1, 2),
s1 AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY 1), s2 AS (SELECT *, (SELECT coalesce(sum(x) / nullif(sum(n), 0), 0.0) FROM s1) AS m FROM s1), s3 AS {_level("s2", "m")},
d2 AS (SELECT d.*, s3.share AS m FROM domains d JOIN s3 USING (suffix)), d3 AS {_level("d2", "m")},
h2 AS (SELECT h.*, d3.share AS m FROM hosts h JOIN d3 USING (domain, suffix)), h3 AS {_level("h2", "m")},
blocked AS (SELECT host FROM h3 WHERE pow(sin(greatest(asin(sqrt(least(share, 1.0))) - {SURE} / (2 * sqrt(n + k + 1)), 0.0)), 2) >= {LIMIT}),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', {i})" for i, (v, r) in enumerate(RULES))}) t(rule, verdict, own, begin, place)),
ruled AS (SELECT row, rule, verdict, row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC, place) AS k FROM p JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, begin))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN (SELECT * FROM ruled WHERE k = 1) USING (row)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label that its id has."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return filter_urls(read_table(spark, sf_dir, "pages"), labels)
