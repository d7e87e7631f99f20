"""UMAP: weights against brute force, the curve, and layouts that keep neighbourhoods."""

import math
import os
import time

import numpy as np
from pyspark.sql import functions as F

from lumenfold.operators import embedding, geometry, neighbour_maps
from lumenfold.operators.neighbours import neighbours
from lumenfold.session import Stored, shared_dir

SCHEMA = "group int, id long, state array<double>"


def blobs(n, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, 8)) * 6
    return centre[np.arange(n) % 5] + rng.normal(size=(n, 8))


def test_fuzzy_links(spark):
    x = blobs(90)
    x[7] = x[8] = x[9]
    k, n = 6, len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = np.zeros((n, n))
    for i in range(n):
        near = sorted((d[i, j], j) for j in range(n) if j != i)[:k]
        rho = min((dist for dist, _ in near if dist > 0), default=0)
        low, high = 0.0, 1e6
        for _ in range(200):
            middle = (low + high) / 2
            total = sum(math.exp(-max(0, dist - rho) / middle) for dist, _ in near)
            low, high = (low, middle) if total > math.log2(k) else (middle, high)
        for dist, j in near:
            want[i, j] = math.exp(-max(0, dist - rho) / max(high, 1e-3 * sum(q for q, _ in near) / k))
    want = want + want.T - want * want.T
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = np.zeros((n, n))
    for r in embedding.fuzzy_links(neighbours(df, k)).collect():
        got[r["a"], r["b"]] = r["w"]
    assert np.allclose(got, want, atol=2e-5) and (got == got.T).all()


def test_curve():
    a, b = embedding.curve()
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01  # as published for a least distance of 0.1


def test_layout_keeps_neighbourhoods(spark):
    x = blobs(200, 1)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3)
    for block in (embedding.BLOCK, 64):
        drawn = embedding.umap(df, 10, 4, 20, block=block)
        y = np.array([r["projected"] for r in sorted(drawn.collect(), key=lambda r: r["id"])])
        assert y.shape == (200, 2) and np.isfinite(y).all()
        kept = geometry.preserved(df, drawn.selectExpr("0 AS `group`", "id", "projected AS state"), 10).first()
        assert kept["trustworthiness"] > 0.85
        # Each point lies closer to its own kind than to others.
        centre = np.stack([y[np.arange(200) % 5 == c].mean(0) for c in range(5)])
        assert (((y[:, None] - centre[None]) ** 2).sum(-1).argmin(1) == np.arange(200) % 5).mean() > 0.97


def test_few_points(spark):
    assert embedding.umap(spark.createDataFrame([], SCHEMA)).collect() == []
    two = embedding.umap(spark.createDataFrame([(0, 1, [1.0]), (0, 2, [2.0])], SCHEMA)).collect()
    assert [r["projected"] for r in two] == [[0.0, 0.0]] * 2


def exact_gradient(p, y, more=1.0):
    gap = y[:, None] - y[None]
    q0 = 1 / (1 + (gap**2).sum(-1))
    np.fill_diagonal(q0, 0)
    return 4 * (((more * p - q0 / q0.sum()) * q0)[:, :, None] * gap).sum(1)


def test_affinities(spark):
    x = blobs(80, 2)
    x[3] = x[4]
    n, perplexity, k = len(x), 5.0, 15
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = np.zeros((n, n))
    for i in range(n):
        near = sorted((math.sqrt(d2[i, j]), j) for j in range(n) if j != i)[:k]
        low, high = 0.0, 1e6
        for _ in range(200):
            beta = (low + high) / 2
            w = np.exp(-beta * (np.array([q for q, _ in near]) ** 2 - near[0][0] ** 2))
            w /= w.sum()
            entropy = -(w[w > 0] * np.log(w[w > 0])).sum()
            low, high = (beta, high) if entropy > math.log(perplexity) else (low, beta)
        want[i, [j for _, j in near]] = w
    want = (want + want.T) / 2 / n
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = np.zeros((n, n))
    for r in neighbour_maps.affinities(neighbours(df, k), perplexity).collect():
        got[r["a"], r["b"]] = r["p"]
    assert np.allclose(got, want, atol=1e-8) and abs(got.sum() - 1) < 1e-9


def test_gradient_is_close_to_the_exact_one(spark):
    rng = np.random.default_rng(7)
    y = np.concatenate([rng.normal(size=(150, 2)) * s + c for s, c in ((1, 0), (3, 12), (0.2, -8))])
    y[5] = y[6]
    n = len(y)
    p = np.zeros((n, n))
    for i in range(n):
        p[i, rng.integers(0, n, 8)] = rng.random(8)
    np.fill_diagonal(p, 0)
    p = (p + p.T) / (p + p.T).sum()
    links = spark.createDataFrame([(int(i), int(j), float(p[i, j])) for i, j in zip(*np.nonzero(p), strict=True)], "a long, b long, p double")
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "id long, x double, y double").repartition(3)
    want = exact_gradient(p, y)
    error = {}
    for depth in (neighbour_maps.DEPTH, 10):
        got = np.zeros((n, 2))
        for r in neighbour_maps.gradient(links, points, depth=depth).collect():
            got[r["id"]] = r["gx"], r["gy"]
        error[depth] = np.linalg.norm(got - want) / np.linalg.norm(want)
    assert error[neighbour_maps.DEPTH] < 0.015 and error[10] < 0.015, error
    # With cells that hold single points and no cell standing for several, it is the exact one.
    whole = neighbour_maps.tree(points, 10)
    force, z = whole.repulsion(y[:20], 0.0)
    gap = y[:20, None] - y[None]
    q0 = 1 / (1 + (gap**2).sum(-1))
    q0[np.arange(20), np.arange(20)] = 0
    assert np.allclose(z, q0.sum(1), rtol=1e-3) and np.allclose(force, ((q0**2)[:, :, None] * gap).sum(1), rtol=1e-2, atol=1e-2)


def test_tsne(spark):
    """A few steps lessen the divergence between affinities and the drawing's."""
    x = blobs(60, 3)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], SCHEMA).coalesce(1)
    p = np.full((60, 60), 1e-12)
    for r in neighbour_maps.affinities(neighbours(df, 15), 5.0).collect():
        p[r["a"], r["b"]] = r["p"]

    def divergence(steps):
        y = np.array([r["projected"] for r in sorted(neighbour_maps.tsne(df, 5.0, steps).collect(), key=lambda r: r["id"])])
        q0 = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(q0, 0)
        q = np.maximum(q0 / q0.sum(), 1e-12)
        return (p * np.log(p / q))[p > 1e-12].sum()

    assert divergence(3) < divergence(0)
    assert neighbour_maps.tsne(spark.createDataFrame([], SCHEMA)).collect() == []


def test_layout_takes_little_disk(spark):
    """Waves of blocks give what one wave does; what they take of the disk goes, and shuffled links are a wave's."""
    rng = np.random.default_rng(4)
    n, folder = 600, shared_dir(spark)
    pairs = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, n, 4000), rng.integers(0, n, 4000), rng.random(4000) + 0.01, strict=True) if a != b}
    # One direction each, points without links, links to and from points that have no place, wide and negative ids.
    wide = [i if i % 50 else (i + 1) * -(1 << 40) for i in range(n)]
    links = spark.createDataFrame([(wide[a], wide[b], w) for (a, b), w in pairs.items()] + [(1, 10**9, 1.0), (10**9, 2, 1.0), (None, 3, 1.0)], "a long, b long, w double").where("a % 7 != 3")
    start = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in zip(wide, rng.normal(size=(n, 2)), strict=True)], "id long, x double, y double").repartition(3)
    before = set(os.listdir(folder))
    got = [sorted(map(tuple, embedding.layout(links, start, 2, 3, block=25).collect()))]
    assert not {f.split("-")[0] for f in set(os.listdir(folder)) - before} & {"start", "places", "links"}
    turns, embedding.TURNS = embedding.TURNS, 100
    try:
        got.append(sorted(map(tuple, embedding.layout(links, start, 2, 3, block=25).collect())))
    finally:
        embedding.TURNS = turns
    assert got[0] == got[1] == sorted(by_links(links.collect(), start.collect(), spark, 2, 3, 25))


def by_links(links, start, spark, rounds, epochs, block):
    """The layout with a row a link and all positions at hand."""
    now = {r["id"]: np.array([r["x"], r["y"]]) for r in start}
    blocks = -(-len(now) // block)
    hashed = lambda turn: [r["id"] for r in spark.createDataFrame([(i,) for i in now], "id long").orderBy(F.xxhash64("id", F.lit(turn))).limit(embedding.SAMPLE).collect()]
    of = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in now], "id long").select("id", F.pmod(F.xxhash64("id"), F.lit(blocks))).collect()}
    a, b = embedding.curve()
    top = max(r["w"] for r in links if r["a"] is not None)
    for turn in range(rounds):
        sample, after = np.array([now[i] for i in hashed(turn)]), dict(now)
        alphas = [1 - (turn * epochs + i) / (rounds * epochs) for i in range(epochs)]
        for one in range(blocks):
            own = sorted((r["a"], r["b"], r["w"]) for r in links if r["a"] in now and r["b"] in now and of[r["a"]] == one)
            ids = sorted({r[0] for r in own})
            if not ids:
                continue
            place = {i: n for n, i in enumerate(ids)}
            rng = np.random.default_rng([turn, ids[0] & 0xFFFFFFFF])
            y = embedding._epochs(np.array([now[i] for i in ids]), np.array([place[r[0]] for r in own]), np.array([place.get(r[1], -1) for r in own]), np.array([now[r[1]] for r in own]), np.array([r[2] / top for r in own]), sample, a, b, alphas, rng)
            after |= dict(zip(ids, y, strict=True))
        now = after
    return [(i, *map(float, at)) for i, at in now.items()]


def test_umap_shuffles_no_positions_with_links(spark, monkeypatch):
    """A round sends packed blocks: no shuffle of it has a row a link."""
    seen, run = [], embedding.Waves.__init__

    def watched(self, waves, of, label):
        def kept(wave):
            seen.append((label, (df := of(wave))._jdf.queryExecution().optimizedPlan().toString()))
            return df

        run(self, waves, kept, label)

    monkeypatch.setattr(embedding.Waves, "__init__", watched)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(blobs(60))], SCHEMA)
    assert embedding.umap(df, 5, 2, 2, block=2).count() == 60
    assert len([1 for label, _ in seen if label == "links"]) == 2
    rounds = [plan for label, plan in seen if label == "places"][1:]
    assert len(rounds) == 4 and not any("Join" in plan for plan in rounds)


def test_stored_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in str(disk.getAllFiles().mkString(",")).split(",") if "shuffle_" in f}
    before = files()
    one = Stored(spark.range(100_000).repartition(3, "id"), "shuffled")
    until = time.time() + 10  # they go by a message
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and one.df.count() == 100_000
    one.drop()
