"""Method names and phrases that extraction looks for, and the cues of its local negation rules."""

from __future__ import annotations

import re

#: Names by category.
METHODS = {
    "clustering": [
        "leiden", "louvain", "kmeans", "k-means", "hdbscan", "dbscan", "spectral_clustering", "agglomerative", "hierarchical_clustering",
        "phenograph", "scanpy_cluster", "seurat_cluster", "sc.tl.leiden", "sc.tl.louvain", "find_clusters", "identify_clusters",
        "cluster_analysis",
    ],
    "trajectory": [
        "monocle", "monocle2", "monocle3", "slingshot", "paga", "velocyto", "scvelo", "rna_velocity", "cellrank", "wishbone", "dpt",
        "diffusion_pseudotime", "palantir", "tempora", "tradeseq",
    ],
    "dim_reduction": [
        "pca", "umap", "tsne", "t-sne", "phate", "diffusion_map", "force_atlas", "spring", "mds", "isomap", "lle",
    ],
    "differential_expression": [
        "deseq2", "edger", "wilcoxon", "t_test", "mast", "scde", "limma", "rank_genes_groups", "findmarkers",
    ],
    "cell_cycle": [
        "cyclum", "tricycle", "ccremover", "scran_cyclone", "seurat_cc", "cell_cycle_scoring", "recat", "cyclingpheno",
        "cell_cycle_regression", "regress_out_cell_cycle", "regress_cell_cycle", "periodic", "cyclical_embedding", "circular_embedding",
    ],
    "spatial": [
        "squidpy", "stlearn", "giotto", "spatialexperiment", "seurat_spatial", "tangram", "cell2location", "stereoscope", "rctd",
    ],
    "integration": [
        "harmony", "scvi", "scanorama", "bbknn", "mnn", "combat", "liger", "seurat_integration", "scgen",
    ],
    "annotation": [
        "celltypist", "singlecellnet", "sctype", "garnett", "cellassign", "scmap", "scpred",
    ],
}
#: Phrases that stand for a method without naming it.
PHRASES = {
    ("trajectory", "trajectory_inference"): (
        r"pseudotime\s+analysis", r"trajectory\s+inference", r"differentiation\s+trajectory", r"developmental\s+trajectory",
        r"lineage\s+tracing", r"cell\s+fate", r"temporal\s+ordering", r"ordering\s+cells", r"branching\s+analysis",
    ),
    ("clustering", "clustering"): (
        r"cluster\s+(?:the\s+)?cells", r"clustering\s+analysis", r"identify\s+(?:cell\s+)?(?:types|populations|clusters)", r"find\s+clusters",
        r"unsupervised\s+clustering", r"differential\s+expression\s+between\s+clusters", r"marker\s+genes\s+(?:for|per)\s+cluster",
    ),
    ("cell_cycle", "cell_cycle_scoring"): (
        r"cell\s+cycle\s+(?:scoring|analysis|phase)", r"score\s+(?:for\s+)?cell\s+cycle", r"g2m\s+(?:score|phase)",
        r"s\s+phase\s+(?:score|genes)", r"mitotic", r"proliferat(?:ion|ing)",
    ),
}
#: Phrases that show that the data are looked at first.
INSPECTION = (
    r"inspect\s+(?:the\s+)?data", r"exploratory\s+analysis", r"examine\s+(?:the\s+)?(?:data|distribution)", r"look\s+at\s+(?:the\s+)?data",
    r"understand\s+(?:the\s+)?structure", r"visualize\s+first", r"quality\s+control", r"qc\s+metrics",
)
#: What ends a clause, rejects, affirms, and condemns after the fact.
BOUNDARY = r"[;!?\n]|(?<!\w)\.|\.(?!\w)|\b(?:but|however|yet|whereas)\b|\binstead\b(?!\s+of)"
REJECTION = (
    r"\b(?:do\s+not|don't|should\s+not|shouldn't|would\s+not|wouldn't|cannot|can't|must\s+not|mustn't)\s+(?:\w+\s+){0,2}?(?:use|recommend|choose|apply)\b"
    r"|\b(?:avoid|reject|neither)\b"
    r"|\b(?:instead\s+of|rather\s+than)\b(?:\s+(?:use|recommend|choose|apply|prefer|try)\b)?"
    r"|\b(?:wrong|inappropriate|unsuitable|not\s+appropriate|not\s+suitable)\s+to\s+(?:use|recommend|choose|apply)\b"
    r"|\bnot\s+(?:use|recommend|choose|apply)\b|\bnot\s*$"
)
AFFIRMATION = r"\b(?:use|recommend|choose|apply|prefer|try)\b"
NEW_SUBJECT = r"^\s+(?:is|can\s+be)\s+(?:appropriate|suitable|useful|recommended|better)\b"
DOUBLE_NEGATION = r"\b(?:do\s+not|don't)\s+(?:avoid|reject)\b"
CONDEMNED = (
    r"^\s*:?\s*(?:(?:,\s*(?:(?:and|or|nor)\s+)?|(?:and|or|nor)\s+)METHOD\s*)*"
    r"(?:(?:(?:is|are|would\s+be|will\s+be)\s+)?(?:not\s+(?:appropriate|suitable|recommended|useful)|wrong|inappropriate|unsuitable)"
    r"|(?:isn't|aren't)\s+(?:appropriate|suitable|recommended|useful)"
    r"|(?:should\s+not|shouldn't|must\s+not|mustn't)\s+be\s+(?:used|recommended)"
    r"|(?:should|must)\s+be\s+(?:avoided|rejected))\b"
)
MOST_WORDS = 8


def needle(pattern: str) -> str:
    """The longest run of letters that all matches of a pattern have: parts in groups may be missing."""
    bare = re.sub(r"\(\?:[^)]*\)\??|\\s\+|\[[^]]*\]\?|\\b|\(\?U\)", " ", pattern)
    return max(re.findall(r"[a-z0-9]+", bare), key=len)


def patterns() -> list[tuple[str, str, str, str]]:
    """(category, method, pattern, needle) of all names and phrases."""
    names = [(c, m, r"(?U)\b" + re.sub("_", r"[\\s_\\-]?", re.sub(r"([.\-])", r"\\\1", m)) + r"\b") for c, ms in METHODS.items() for m in ms]
    phrases = [(c, m, "(?U)" + p) for (c, m), ps in PHRASES.items() for p in ps]
    return [(c, m, p, needle(p)) for c, m, p in names + phrases]


def first_words(method: str, pattern: str) -> set[str]:
    """The words of letters, digits and underscores that a name's matches can start with; none for a phrase, which may
    start inside a word."""
    if not pattern.startswith(r"(?U)\b"):
        return set()
    parts = re.split(r"[.\-]", method, maxsplit=1)[0].split("_")
    out, whole = {parts[0]}, {parts[0]}
    for part in parts[1:]:
        whole = {w + sep + part for w in whole for sep in ("", "_")}
        out |= whole
    return out


def quick(pattern: str) -> str:
    """A name's pattern that looks at the next letter before it looks for a word's start."""
    return re.sub(r"^\(\?U\)\\b(.)", r"(?U)(?=\1)\\b\1", pattern)


def either(words: set[str]) -> str:
    """A pattern of any of the words, which branches letter by letter, so that a place in a text is ruled out by one."""
    ends = "" in words
    branches = [first + either({w[1:] for w in words if w[:1] == first}) for first in sorted({w[0] for w in words if w})]
    if not branches:
        return ""
    whole = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
    return f"{whole}?" if ends else whole
