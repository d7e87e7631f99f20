import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import vocabulary as v
from lumenfold.functions.text import running, spans
from lumenfold.operators.evaluate import format_metric, jaccard_map, jaccard_pairs, jaccard_summary, summary_table, system_metrics
from lumenfold.operators.extract import extract_methods, match, violations

#: Forms of sentences that reject {a}, and that recommend {a} beside a rejected {b}, by the cue that they are about.
REJECTING = {
    "prefix": ("Please avoid {a} here.", "You should not use {a} on counts.", "We cannot recommend {a} for this.", "They do not ever choose {a}.", "One must not apply {a} blindly."),
    "instead": ("Pick {b} instead of {a}.", "Try {b} rather than {a}.", "Rather than {a} it could be {b}."),
    "suffix": ("{a} is unsuitable for sparse data.", "{a} must not be used.", "{a} should be rejected at once.", "{a} aren't useful.", "{a} will be wrong.", "{a}: not recommended."),
    "listed": ("{b}, {a} are not suitable.", "Reject {b} and {a}.", "Neither {b} nor {a} will do."),
    "marked": ("Never mind; do not use `{a}`.", "It is unsuitable to apply **{a}**."),
}
RECOMMENDING = {
    "clause": ("Avoid {b}; use {a}.", "{b} is inappropriate, but {a} fits.", "{b} is wrong, whereas {a} is fine.", "{b} should be avoided! Take {a}.", "Reject {b}. {a} will do."),
    "affirmed": ("Avoid {b} and try {a}.", "Instead of {b} we prefer {a}.", "Do not use {b} but choose {a}."),
    "doubled": ("Do not reject {a} yet.", "Don’t avoid {a}."),
    "comma": ("Avoid {b}, {a} is useful.", "We reject {b}, {a} can be recommended."),
    "far": ("Avoid long waits on a shared machine in the evening hours with {a}.",),
    "twice": ("{a} is good. Avoid {a} for {b}.",),
}
PAIRS = (("phate", "leiden"), ("harmony", "louvain"), ("slingshot", "k-means"), ("scvi", "hierarchical_clustering"))
REJECTED = {f.format(a=a, b=b): a for fs in REJECTING.values() for f in fs for a, b in PAIRS}
AFFIRMED = {f.format(a=a, b=b): a for fs in RECOMMENDING.values() for f in fs for a, b in PAIRS}


@pytest.fixture(scope="module")
def found(spark):
    phrases = [f"{cue} {p}." for p in ("trajectory inference", "cluster the cells", "cell cycle scoring") for cue in ("Use", "Do not use")]
    rows = [(t,) for t in [*REJECTED, *AFFIRMED, *phrases, "", "Use k-means, sc.tl.leiden and spectral clustering."]] + [(None,)]
    return {r["text"]: r for r in extract_methods(spark.createDataFrame(rows, "text string")).collect()}


def test_rejected(found):
    assert [t for t, m in REJECTED.items() if m in found[t]["extracted_methods"]] == []


def test_affirmed(found):
    assert [t for t, m in AFFIRMED.items() if m not in found[t]["extracted_methods"]] == []


def test_needles():
    """A pattern's letters are in all that it matches."""
    for category, method, pattern, letters in v.patterns():
        if (category, method) not in v.PHRASES:
            assert letters in method and all(re.search(pattern.removeprefix("(?U)"), f" {method.replace('_', gap)} ") for gap in ("_", " ", "-", ""))
    assert {n for *_, n in v.patterns()} >= {"pseudotime", "proliferat", "g2m", "mitotic", "phase"} and len(v.patterns()) == 113


def test_spans(spark):
    texts = ["ab ab  é ab", "", "abababab" * 200, None, "xx"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("id", "t", spans(F.col("t"), F.lit("ab")).alias("s")).collect():
        assert [tuple(x) for x in r["s"] or []] == [m.span() for m in re.finditer("ab", r["t"] or "")]
    numbers = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 127, 128, 129, 1000)], "x array<bigint>")
    assert all(r["r"] == np.cumsum(r["x"]).tolist() for r in numbers.select("x", running(F.col("x")).alias("r")).collect())


def test_phrases_and_empty(found):
    for phrase, flag in (("trajectory inference", "mentions_trajectory"), ("cluster the cells", "mentions_clustering"), ("cell cycle scoring", "mentions_cell_cycle")):
        assert found[f"Use {phrase}."][flag] and not found[f"Do not use {phrase}."][flag]
    assert found[None]["extracted_methods"] == found[""]["extracted_methods"] == []
    assert found["Use k-means, sc.tl.leiden and spectral clustering."]["extracted_methods"] == ["k-means", "leiden", "sc.tl.leiden", "spectral_clustering"]


def test_match(spark):
    rows = [(1, ["UMAP", "Leiden"], ["umap", "phate"], ["leiden"]), (2, ["leiden"], [], ["leiden"]), (3, ["umap"], ["umap"], None), (4, [], None, ["x"])]
    df = spark.createDataFrame(rows, "id int, extracted_methods array<string>, ground_truth array<string>, failure array<string>")
    d = {r["id"]: r["d"] for r in df.select("id", match().alias("d")).collect()}
    assert (d[1]["matches"], d[1]["ground_truth_matches"], d[1]["failure_matches"], d[1]["match_ratio"]) == (False, ["umap"], ["leiden"], 0.5)
    assert d[2]["matches"] is None and d[3]["matches"] is True and d[4]["matches"] is None


def _results(spark, rows):
    return spark.createDataFrame(rows, "system string, prompt_id string, pos int, success boolean, extracted_methods array<string>, mentions_clustering boolean")


def test_jaccard(spark):
    rows = [("s", f"{g}_{c}", i, True, [g], False) for i, (g, c) in enumerate((g, c) for g in ("leiden", "slingshot", "phate") for c in "ABC")] + [("one", "p", 0, True, ["pca"], False), ("none", "p", 0, False, [], False), ("e", "a", 0, True, [], False), ("e", "b", 1, True, [], False)]
    s = {r["system"]: r for r in jaccard_summary(_results(spark, rows)).collect()}
    assert (s["s"]["pairs"], s["s"]["mean"]) == (36, 0.25) and s["one"]["mean"] is None and s["none"]["pairs"] == 0 and s["e"]["mean"] == 1.0
    rows = [("s", p, i, True, [m], False) for i, (p, m) in enumerate((("a", "leiden"), ("b_vs_c", "leiden"), ("a_vs_b", "pca"), ("c", "umap")))]
    pairs = {r["pair"]: r["similarity"] for r in jaccard_pairs(_results(spark, rows)).collect()}
    assert len(pairs) == 6 and pairs['["a", "b_vs_c"]'] == 1.0 and sum(pairs.values()) == 1.0
    assert jaccard_map(_results(spark, rows)).first()["pairs"] == pairs


def test_metrics_and_tables(spark):
    prompts = spark.createDataFrame([("p", "g", ["umap"], ["leiden"]), ("q", None, [], [])], "prompt_id string, expected_geometry string, ground_truth array<string>, failure array<string>")
    rows = [("a", "p", 0, True, ["umap"], False), ("b", "p", 0, True, ["umap"], True), ("b", "q", 1, True, ["pca"], False), ("c", "p", 0, False, [], None)]
    m = system_metrics(_results(spark, rows), prompts)
    got = {r["system"]: r for r in m.collect()}
    assert got["a"]["ground_truth_match_rate"] == 1.0 and got["b"]["ground_truth_match_rate"] is None and got["c"]["ground_truth_match_rate"] is None
    assert (got["b"]["clustering_for_all_rate"], got["c"]["prompts_evaluated"], got["c"]["prompts_failed"]) == (0.5, 0, 1)
    assert "| c | n/a | n/a | n/a |" in summary_table(m).first()["summary"] and r"100\%" in summary_table(m, "latex").first()["summary"]
    with pytest.raises(ValueError):
        summary_table(m, "html")
    shown = spark.range(1).select(*(format_metric(F.lit(x), f).alias(str(k)) for k, (x, f) in enumerate([(0.256, ".1%"), (0.125, ".0%"), (0.125, ".2f"), (1.0, ".0%"), (None, ".2f")]))).first()
    assert list(shown) == ["25.6%", "12%", "0.12", "100%", "n/a"]


def test_violations(spark):
    row = spark.sql("select 1 as beta0, 0 as beta1, true as mentions_clustering, true as mentions_cell_cycle").select(*violations()).first()
    assert row["any_violation"] and len(row["violation_details"]) == 2
