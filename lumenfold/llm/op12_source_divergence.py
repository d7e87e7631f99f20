"""Source divergence audit: how far each source's use of terms lies from the other sources of its language.

A group is a (lang, source); a term's share in it is p = 1 + floor(UNIT * (n + 1) / (N + V)), n its occurrences there, N
those of all kept terms, V the number of kept terms of the language. The divergence of p from q is the sum over kept
terms of floor((p - q)^2 / q). Terms that both groups lack cost one constant; so with S(g) the terms that g has,

  sum = [over S(g): f(p, q0)] + [over S(h): f(p0, q)] + [over both: f(p, q) - f(p, q0) - f(p0, q)] + rest * f(p0, q0),

q0 and p0 the share of a term that doesn't occur. The first two sums need only each group's histogram of counts, the
third a join of postings of one term, and no group is ever held beside the whole vocabulary. All numbers are whole:
shares are below 1.1e9 and their sums of squares below 2^63, counts up to 2.8e14 a group.

Tasks count words before anything is shuffled, by a bounded table, so a source with most of the rows costs no more than
others, and a term meets only as many rows as tasks and sources have it. Terms by group are ranked in each task before
the best are brought together.

Null text, lang and source count as ''. Texts of any length are counted whole, in pieces of bounded memory. Repeated
rows are documents of their own. Groups without terms have pairs, with a V of 0 of value 0. Ties go by the item in
UTF-8 order. An empty table gives no rows. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.session import cut, discard, read_table, shared_path, ship

#: Documents of a language that a kept term has at least; the ranks of terms; shares' unit.
LEAST_DOCS, RANKS, UNIT = 3, 200, 1_000_000_000
#: Terms that a task holds before it gives its counts away.
HELD = 400_000
#: The contract's term characters, which are letters and all beyond ASCII.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _pieces(text: bytes, size: int = 8_000_000) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, in pieces that end at a blank."""
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + size)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) -> a term's occurrences and documents by group; the term '' for each group itself."""
    uses: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in uses.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        uses.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (lang, source) not in uses:
                uses[lang, source] = Counter({b"": 0}), Counter()
            n, docs = uses[lang, source]
            before, own = len(n), set()
            for words in _pieces(text.as_py().translate(LETTERS)):
                n.update(words)
                own.update(words)
            docs.update(own)
            held += len(n) - before
            if held >= HELD:
                yield from out()
                held = 0
    yield from out()


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + v)) without numbers beyond a long: UNIT in two factors."""
    high, low = 32_000, UNIT // 32_000
    n, m = n + 1, total + v
    first = div(n * high, m)
    return 1 + first * low + div((n * high - first * m) * low, m)


def cost(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """docs with lang, source, text: lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    ship(spark)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counted = docs.select(blank("lang"), blank("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(_count, COUNTS)
    # One exchange by term serves the sums by group, the documents of the language and the list of a term.
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    listed = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
    folders = [shared_path(spark, name) for name in ("terms", "groups")]
    listed.where((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "uses").write.parquet(folders[0])
    terms = spark.read.parquet(folders[0])

    flat = terms.select("lang", "term", F.inline("uses"))
    counts = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("term") != "").alias("support"))
    size = terms.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"))
    one = counts.join(size, "lang").withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))))
    one.withColumn("whole", F.sum("total").over(Window.partitionBy("lang"))).write.parquet(folders[1])
    # Read from a file, groups have a known size, so joins broadcast them exactly where they are small.
    groups = spark.read.parquet(folders[1])

    posted = terms.where("term <> ''").select("lang", "term", F.aggregate("uses", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("all"), F.inline("uses")).join(groups, ["lang", "source"])
    own_share, lang_share = share(*map(F.col, ("n", "total", "v"))), share(*map(F.col, ("all", "whole", "v")))
    better = posted.select("lang", "source", "term", own_share.alias("p"), lang_share.alias("q")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), cost(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = better.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    own, other = groups, groups.select("lang", F.col("source").alias("item"), F.col("support").alias("item_support"), F.col("zero").alias("item_zero"))
    counts_of = flat.where("term <> ''").groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("k")).join(groups, ["lang", "source"])
    priced = counts_of.select("lang", "source", "k", own_share.alias("p"))
    sides = priced.join(other, "lang").where("source <> item").groupBy("lang", "source", "item")
    sides = cut(sides.agg(F.sum(F.col("k") * cost(F.col("p"), F.col("item_zero"))).alias("forth"), F.sum(F.col("k") * cost(F.col("item_zero"), F.col("p"))).alias("back")))
    posting = posted.select("lang", "term", "source", own_share.alias("p"), "zero")
    left, right = posting, posting.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "zero", "q0"))
    both = left.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item")
    both = cut(both.agg(F.count(F.lit(1)).alias("shared"), F.sum(cost(p, q) - cost(p, q0) - cost(p0, q)).alias("forth"), F.sum(cost(q, p) - cost(q, p0) - cost(q0, p)).alias("back")))
    mend = both.select("lang", "source", "item", "shared", F.col("forth").alias("mend")).union(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "shared", F.col("back").alias("mend")))
    key = ["lang", "source", "item"]
    pairs = own.join(other, "lang").where("source <> item")
    pairs = pairs.join(sides.select(*key, "forth"), key, "left").join(sides.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "back"), key, "left").join(mend, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = F.col("v") - F.col("support") - F.col("item_support") + zero("shared")
    value = F.when(F.col("v") > 0, zero("forth") + zero("back") + zero("mend") + rest * cost(F.col("zero"), F.col("item_zero"))).otherwise(0)
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(order))
    done = cut(by_pair.union(by_term))
    for folder in folders:
        discard(spark, folder)
    return done


_SHARE = "(1 + {u}::HUGEINT * ({n} + 1) // ({m} + v))"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
used AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
size AS (SELECT g.lang, count(DISTINCT term) AS v FROM g LEFT JOIN kept ON g.lang = kept.lang GROUP BY 1),
total AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS m FROM g LEFT JOIN used ON g.lang = used.lang AND g.source = used.source GROUP BY 1, 2),
shares AS (SELECT t.lang, t.source, kept.term, coalesce(n, 0) AS n, {_SHARE.format(u=UNIT, n="coalesce(n, 0)", m="m")} AS p
  FROM total t JOIN size ON size.lang = t.lang JOIN kept ON kept.lang = t.lang LEFT JOIN used u ON u.lang = t.lang AND u.source = t.source AND u.term = kept.term),
langs AS (SELECT lang, sum(m) AS m FROM total GROUP BY 1),
whole AS (SELECT u.lang, u.term, {_SHARE.format(u=UNIT, n="u.n", m="m")} AS q FROM (SELECT lang, term, sum(n) AS n FROM used GROUP BY 1, 2) u JOIN langs ON langs.lang = u.lang JOIN size ON size.lang = u.lang),
costs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN costs c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source),
term AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares s JOIN whole ON whole.lang = s.lang AND whole.term = s.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {RANKS}"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))
