"""Hard negatives, source divergence and URL filters against brute force: nulls, empty and long values, ties, repeats, clashing columns."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import op11_hard_negatives, op12_source_divergence, op13_url_filters

VECTORS = "vec_id long, embedding array<float>, label int, block long, w long, ids string, score double"


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    single = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, single(base[rng.integers(12)] + rng.normal(size=6) * 0.3), int(rng.integers(0, 4))) for i in range(500)]
    # A third of the rows are copies of one vector, in two labels: ties that only ids tell apart.
    rows += [(1000 + 3 * i, single(base[0] * 0.8), 1 + i % 2) for i in range(300)]
    rows += [(5, rows[5][1], 1)] * 30 + [rows[100]] * 2 + [(300, None, 1), (400, single([0] * 6), 2)]
    rows += [(None, single(base[0]), 1), (7001, single(base[0]), None), (7002, None, 1), (7003, [1.0, None, 2.0], 2), (7004, [1.0, math.nan], 2), (7005, [math.inf] * 6, 1)]
    return rows + [(7100, [], 2), (7200, [1.0, 0.5], 2), (7201, [1.0] * 9, 1), (-100, single(base[1]), 3)]


def mined(rows):
    used = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    used = [(i, math.fmod(l + 1, 10) if i % 7 == 0 else l, v) for i, l, v in used]
    out = []
    for i, label, v in used:
        if i % 100 == 0:
            scores = [(-sum(x * y for x, y in zip(v, w, strict=False)), j, m) for j, m, w in used if j != i]
            for top, p, _ in sorted(s for s in scores if s[2] == label)[:5]:
                fit = sorted(s[:2] for s in scores if s[2] != label and -30 * top <= -100 * s[0] <= -90 * top)[:10]
                out += [(i, p, k + 1, n, -top, -s) for k, (s, n) in enumerate(fit)]
    return sorted(out)


def found(df, scale=256, **blocks):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = df.select(F.col("vec_id").alias("i"), label.alias("l"), F.col("embedding").alias("v"))
    return sorted(map(tuple, op11_hard_negatives.hard_negatives(rows, F.col("i") % 100 == 0, **blocks).collect()))


def test_hard_negatives(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2, "x", 0.5) for r in rows], VECTORS).repartition(5)
    want = mined(rows)
    assert len(want) > 100 and found(df) == want
    assert found(df, block_rows=97, block_anchors=3) == want


def test_hard_negatives_of_few(spark):
    assert found(spark.createDataFrame([], VECTORS)) == []
    alone = [(100, [1.0, 0.0], 1, 1, 2, "x", 0.5)]
    assert found(spark.createDataFrame(alone, VECTORS)) == []
    # No positives without a row of the label, no negatives for a positive of a negative score.
    assert found(spark.createDataFrame([*alone, (1, [1.0, 0.0], 2, 1, 2, "x", 0.5), (2, [-1.0, 0.0], 1, 1, 2, "x", 0.5)], VECTORS)) == []
    large = [(100, [3e18], 1, 1, 2, "x", 0.5), (1, [1.0], 2, 1, 2, "x", 0.5)]
    with pytest.raises(Exception, match="doesn't fit a long"):
        found(spark.createDataFrame(large, VECTORS))


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, lang string, source string, text string, term string, n long, v long, zero long, item string, value long"


def diverged(rows, least=3, ranks=200):
    group, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        words = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        group[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in docs.items()}
    share = lambda n, total, v: 1 + 10**9 * (n + 1) // (total + v)
    p, q = {}, {}
    for (lang, source), n in group.items():
        total = sum(n[t] for t in kept[lang])
        p[lang, source] = {t: share(n[t], total, len(kept[lang])) for t in kept[lang]}
    for lang, terms in kept.items():
        n = {t: sum(c[t] for (a, _), c in group.items() if a == lang) for t in terms}
        q[lang] = {t: share(n[t], sum(n.values()), len(terms)) for t in terms}
    out = []
    for (lang, source), own in p.items():
        pairs = [(-sum((x - other[t]) ** 2 // other[t] for t, x in own.items()), b) for (a, b), other in p.items() if a == lang and b != source]
        terms = [(-((x - q[lang][t]) ** 2 // q[lang][t]), t) for t, x in own.items() if group[lang, source][t] and x > q[lang][t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, item, -value, k + 1) for k, (value, item) in enumerate(ranked if part == "pair" else ranked[:ranks])]
    return sorted(out)


def documents():
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Éa", "日本", "ÀB", "ß", "𝒳y"]
    say = lambda n: " ".join(words[int(len(words) * x**2)] + ["", ",", " 12", "X"][int(4 * x)] for x in rng.random(n))
    rows = [(["en", "fr"][i % 5 == 0], f"s{0 if i % 3 == 0 else i % 11}", say(int(rng.integers(1, 60)))) for i in range(250)]
    rows += [rows[0]] * 5 + [("en", "empty", ""), ("en", "null", None), (None, None, "wa wb"), (None, "s1", None), ("de", "one", "nur hier"), ("de", "two", "nur da"), ("en", "Z", "1 2 3"), ("en", "é", "word " * 40)]
    return rows + [("en", "long", say(20_000)), ("fr", "", "wa"), ("fr", None, "wb wa")]


def test_divergence(spark, monkeypatch):
    rows = documents()
    df = spark.createDataFrame([(i, *r, "t", 1, 2, 3, "i", 4) for i, r in enumerate(rows)], DOCS).repartition(4)
    want = diverged(rows)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[2] == "pair" and r[4] == 0 for r in want)
    assert sorted(map(tuple, op12_source_divergence.divergence(df).collect())) == want
    assert sorted(map(tuple, op12_source_divergence.divergence(df, 2, 5).collect())) == diverged(rows, 2, 5)
    assert op12_source_divergence.divergence(df.limit(0)).collect() == []


def test_divergence_in_pieces():
    text = "ab cd".encode() * 50
    assert [w for size in (1, 7) for p in op12_source_divergence._pieces(text, size) for w in p] == text.split() * 2


def test_shares(spark):
    rows = [(0, 0, 1), (0, 5, 3), (7, 9, 4), (10**14, 2 * 10**14, 10**6), (2 * 10**14, 2 * 10**14, 1)]
    got = spark.createDataFrame(rows, "n long, m long, v long").select(op12_source_divergence.share(F.col("n"), F.col("m"), F.col("v")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 1) // (m + v) for n, m, v in rows]


URLS = [
    "http://a.net", "http://A.Net/x", "http://net/", "http://xnet/", "https://sub.a.net:80/x", "http://e.example.net/en/a?b=/fr/", "http://example.net/en", "http://example.net/en/", "http://EXAMPLE.net/EN/",
    "http://b.example.com/de/#x", "http://example.com/de", "http://o.org/fr/", "http://o.org?x=/fr/", "http://o.org#/fr/", "ftp://u:p@o.org/fr/1", "no scheme", "", None, "://", "http://İ.org/fr/", "http:///path/x", "x://y://z.net/a", "http://org/fr/\nnew", "http://192.168.0.1/a", "http://a.co.uk/b",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if c.isascii() else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fits = [(len(r), r, v) for v, r in op13_url_filters.RULES if (host == (own := r.split("/", 1)[0]) or host.endswith("." + own)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string, r string")
    outcomes = spark.createDataFrame([], "page_id long, bad long")
    got = {r["page_id"]: tuple(r)[1:] for r in op13_url_filters.filter_urls(pages, outcomes).collect()}
    assert got == {i: (*judged(u)[:3], judged(u)[3] or "allow") for i, u in enumerate(URLS)}
    assert op13_url_filters.filter_urls(pages.limit(0), outcomes).collect() == []
    assert {r["verdict"] for r in op13_url_filters.filter_urls(pages, outcomes, ()).collect()} == {"allow"}
    both = (("block", "o.org/"), ("allow", "org/fr"), ("allow", "o.org/"))
    assert {(r["rule"], r["verdict"]) for r in op13_url_filters.filter_urls(pages.where("url LIKE '%//o.org/fr/%'"), outcomes, both).collect()} == {("o.org/", "block")}


def shrink(nodes, parent):
    """nodes: name -> (n, x); parent: name -> mean. The posterior means and the level's precision, as its docstring tells them."""
    mean = {k: parent[k] for k in nodes}
    spread = sum(((x - n * mean[k]) ** 2 - n * mean[k] * (1 - mean[k])) / (n - 1) for k, (n, x) in nodes.items() if n > 1)
    most = sum(n * mean[k] * (1 - mean[k]) for k, (n, x) in nodes.items() if n > 1)
    rho = min(max(spread / most if most else 0, op13_url_filters.LEAST_RHO), op13_url_filters.MOST_RHO)
    k0 = 1 / rho - 1
    return {k: (x + k0 * mean[k]) / (n + k0) for k, (n, x) in nodes.items()}, k0


def test_reputations(spark):
    rng = np.random.default_rng(8)
    hosts = {f"h{i}.{d}.{s}": 0.9 if d == "bad" else 0.05 for i in range(12) for d in ("bad", "good", "fine") for s in ("com", "co.uk")} | {"new.bad.com": None, "evil.good.com": 1.0, "": 0.0, "10.0.0.1": 0.2}
    pages, labels = [], []
    for host, share in hosts.items():
        # One host has a third of all pages.
        for _ in range({"h3.good.com": 600, "evil.good.com": 60}.get(host) or int(rng.integers(5, 40))):
            pages.append((len(pages), host))
            if share is not None and rng.random() < 0.7:
                labels += [(len(pages) - 1, int(rng.random() < share))] * int(rng.integers(1, 3))
    pages += [(None, "h1.good.com"), pages[0]]
    labels += [(None, 1), (3, None), (10**9, 1)]
    told = {}
    for i, bad in labels:
        if i is not None and bad is not None:
            told.setdefault(i, []).append(bad)
    told = {i: int(sum(b) / len(b) > 0.5) for i, b in told.items()}
    domain = lambda h: h if re.fullmatch(r"[0-9.]*", h) else ".".join(h.split(".")[-3 if h.endswith("co.uk") else -2 :])
    suffix = lambda h: "" if re.fullmatch(r"[0-9.]*", h) else "co.uk" if h.endswith("co.uk") else h.split(".")[-1]
    count = lambda f: {k: tuple(sum(x) for x in zip(*((int(i in told), told.get(i, 0)) for i, h in pages if f(h) == k), strict=True)) for k in {f(h) for _, h in pages}}
    by_suffix, by_domain, by_host = count(suffix), count(lambda h: (domain(h), suffix(h))), count(lambda h: h)
    n, x = (sum(v[k] for v in by_suffix.values()) for k in (0, 1))
    top, _ = shrink(by_suffix, dict.fromkeys(by_suffix, x / n))
    middle, _ = shrink(by_domain, {k: top[k[1]] for k in by_domain})
    low, k0 = shrink(by_host, {h: middle[domain(h), suffix(h)] for h in by_host})
    df = spark.createDataFrame(pages, "page_id long, host string")
    got = {r["host"]: r for r in op13_url_filters.reputations(df, spark.createDataFrame(labels, "page_id long, bad long")).collect()}
    assert got.keys() == by_host.keys() and all((r["n"], r["x"]) == by_host[h] and math.isclose(r["share"], low[h], rel_tol=1e-9) for h, r in got.items())
    bound = {h: math.sin(max(0, math.asin(math.sqrt(s)) - op13_url_filters.SURE / 2 / math.sqrt(by_host[h][0] + k0 + 1))) ** 2 for h, s in low.items()}
    assert all(math.isclose(r["bound"], bound[h], rel_tol=1e-9, abs_tol=1e-12) for h, r in got.items())
    # Hosts of a bad domain go, one without labels too, and a bad host of a good domain; good ones stay.
    urls = df.select("page_id", F.concat(F.lit("http://"), "host", F.lit("/")).alias("url"))
    verdicts = {(r["host"], r["verdict"]) for r in op13_url_filters.filter_urls(urls, spark.createDataFrame(labels, "page_id long, bad long"), ()).collect()}
    assert verdicts == {(h, "block" if bound[h] >= op13_url_filters.LIMIT else "allow") for h in by_host}
    assert {("evil.good.com", "block"), ("h1.good.com", "allow"), ("h3.good.com", "allow"), ("h1.bad.com", "block"), ("new.bad.com", "block")} <= verdicts
