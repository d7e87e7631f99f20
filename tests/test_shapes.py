"""Neighbours by blocks, tangent spaces and the shipped metrics against NumPy."""

import math
import os
import re
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import geometry as g
from lumenfold.operators import neighbours as nb
from lumenfold.operators import tangent
from lumenfold.session import clean_cut, cut, shared_dir, ship
from lumenfold.sources import metrics, registry

SCHEMA = "group string, id int, state array<double>"


def nearest(rows, k):
    out, groups = [], {}
    for group, i, v in rows:
        if group is not None and v is not None:
            groups.setdefault(group, []).append((i, np.array(v, float)))
    for group, points in groups.items():
        for i, v in points:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in points if j != i)[:k]
            out += [(group, i, j, r + 1) for r, (_, j) in enumerate(near)]
    return sorted(out)


def cloud():
    rng = np.random.default_rng(0)
    rows = []
    for group, n in (("a", 220), ("b", 40), ("c", 3), ("d", 1)):
        for i, t in enumerate((rng.random(n) * 20).tolist()):
            rows.append((group, i, [math.sin(t), math.cos(t), t, float(rng.normal()) * 0.1]))
    # Copies, a grid full of ties, vectors of another length, of no length, and rows that take no part.
    rows += [("a", 1000 + i, rows[0][2]) for i in range(150)] + [("grid", 10 * i + j, [float(i), float(j)]) for i in range(9) for j in range(9)]
    return rows + [("b", 900, None), (None, 1, [1.0] * 4), *(("e", i, [0.0, -0.0]) for i in range(3)), *(("f", i, []) for i in range(2))]


@pytest.mark.parametrize("block, fan", [(16, 4), (256, 32)])
def test_neighbours(spark, block, fan):
    rows = cloud()
    got = nb.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, block=block, fan=fan)
    assert got.dtypes[0] == ("group", "string") and got.dtypes[1] == ("id", "int")
    assert sorted((r["group"], r["id"], r["other"], r["rank"]) for r in got.collect()) == nearest(rows, 5)


def test_neighbours_of_none(spark):
    assert nb.neighbours(spark.createDataFrame([], SCHEMA), 3).collect() == []


def test_blocks_leave_out_far_cells(spark):
    """Of vectors along lines, a share of the pairs is tried that falls with their number."""
    rng = np.random.default_rng(1)
    ship(spark)
    shares = []
    for n in (600, 2400):
        along = rng.random(n) * n / 10
        points = spark.createDataFrame([(0, i, [float(t), float(x)]) for i, (t, x) in enumerate(zip(along, rng.random(n), strict=True))], "g int, id long, v array<double>")
        blocks = nb.Blocks(cut(points), 5, 32, 8)
        found = blocks.nearest().count()
        shares.append(blocks.tried / n**2)
        assert found == 5 * n
    assert shares[1] < 0.12 and shares[1] < shares[0] / 2


def test_tangent_spaces(spark):
    rng = np.random.default_rng(2)
    u, v = rng.random(80), rng.random(80)
    sheet = [("sheet", i, [float(u[i]), float(v[i]), 0.0, 0.0]) for i in range(80)]
    bent = [("bent", i, [math.cos(t), math.sin(t), 0.0]) for i, t in enumerate(np.linspace(0, 6, 60))]
    same = [("same", i, [1.0, 2.0]) for i in range(12)] + [("few", i, [float(i), 0.0]) for i in range(3)]
    df = spark.createDataFrame(sheet + bent + same, SCHEMA)
    got = {r["group"]: r for r in tangent.tangent_space(df, 6, 1, 0.9).collect()}
    assert got["sheet"]["dimension"] > 1.5 and got["bent"]["dimension"] == 1 and got["same"]["dimension"] == 0 and "few" not in got
    spaces = {(r["group"], r["id"]): np.array(r["basis"]).reshape(1, -1) for r in tangent.tangent_spaces(df, 6, 1, 0.9).collect()}
    own = {}
    for group, i, j, _ in nearest(sheet + bent, 6):
        points = {p[1]: np.array(p[2]) for p in sheet + bent if p[0] == group}
        near = [points[b] for a, x, b, _ in nearest([(group, q, w) for q, w in points.items()], 6) if x == i] if (group, i) not in own else None
        if near is not None:
            c = np.array(near) - np.mean(near, 0)
            w, e = np.linalg.eigh(c.T @ c)
            own[group, i] = e[:, -1]
            assert abs(abs(spaces[group, i][0] @ e[:, -1]) - 1) < 1e-6
    for name in ("sheet", "bent"):
        angle = [math.acos(min(1, abs(own[a, i] @ own[a, j]))) for a, i, j, _ in nearest(sheet + bent, 6) if a == name]
        assert math.isclose(got[name]["angle"], np.mean(angle), abs_tol=1e-5)


def test_angles():
    a = np.eye(4)[None, :2]
    t = 1e-9
    b = np.array([[[math.cos(t), 0, math.sin(t), 0], [0, math.cos(0.7), 0, math.sin(0.7)]]])
    assert np.allclose(tangent.angles(a, b), [[t, 0.7]], rtol=1e-6, atol=0)
    assert np.allclose(tangent.angles(a, np.eye(4)[None, 2:]), math.pi / 2)


def test_shipped_metrics(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 5)) * [3, 1, 1, 0.1, 0.1]
    rows = [(i, v.tolist(), v[:2].tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "id long, state array<double>, projected array<double>")
    ready = registry.set_up(metrics.catalogue(), list(metrics.SHIPPED))
    got = {r["metric"]: (r["score"], r["error"]) for r in registry.execute(spark, ready, embedding=frame.drop("projected"), module=frame).collect()}
    assert all(error is None and math.isfinite(score) for score, error in got.values()) and set(got) == set(metrics.SHIPPED)
    w = np.linalg.eigvalsh(np.cov(x.T))
    assert math.isclose(got["participation_ratio"][0], w.sum() ** 2 / (w**2).sum(), rel_tol=1e-9)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert math.isclose(got["anisotropy"][0], (unit.mean(0) ** 2).sum(), rel_tol=1e-9) and got["connected_components"][0] == 1
    cos = (unit[1:] * unit[:-1]).sum(1)
    assert math.isclose(got["trajectory_velocity"][0], (1 - cos).mean(), rel_tol=1e-9) and 0.9 < got["trustworthiness"][0] <= 1 and got["tangent_space"][0] > 1
    alone = registry.execute(spark, ready, embedding=frame.drop("projected").limit(1)).collect()
    assert {r["metric"] for r in alone} == {n for n, (group, _) in metrics.SHIPPED.items() if group == "embedding"}
    with pytest.raises(KeyError):
        registry.set_up(metrics.catalogue(), ["unknown"])
    assert g.neighbours is nb.neighbours


def test_closer_vectors_are_counted_by_tiles(spark):
    """Ranks of any pairs, among copies and ties, in blocks that are much smaller than a group."""
    groups, pairs, wanted = {}, [], {}
    for group, i, v in cloud():
        if group in ("a", "b", "grid") and v is not None:
            groups.setdefault(group, []).append((i, v))
    rng = np.random.default_rng(2)
    for group, points in groups.items():
        x = np.array([v for _, v in points])
        for a in range(0, len(points), 3):
            d = np.sqrt(((x[a] - x) ** 2).sum(1))
            for b in rng.choice(len(points), rng.integers(0, 4), replace=False).tolist():
                if a != b:
                    pairs.append((group, points[a][0], points[b][0]))
                    wanted[group] = wanted.get(group, 0) + sum((d[c], points[c][0]) < (d[b], points[b][0]) for c in range(len(points)) if c != a)
    ship(spark)
    rows = spark.createDataFrame([(group, i, v) for group, points in groups.items() for i, v in points], "g string, id long, v array<double>")
    got = nb.Blocks(rows.repartition(3), 5, 16, 4).closer(spark.createDataFrame(pairs, "g string, id long, other long"))
    assert {r["g"]: r["closer"] for r in got.collect()} == wanted


def test_metrics_share_neighbours(spark, monkeypatch):
    """Neighbours of a frame are found once, whichever metrics look at them and at however many."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(60)], "id long, state array<double>")
    alone = [metrics.local_intrinsic_dimensionality(rows, 3), metrics.local_intrinsic_dimensionality(rows, 5), metrics.connected_components(rows, 2)]
    alone = [d.first()["value"] for d in alone]
    calls, found = [], g.neighbours
    monkeypatch.setattr(g, "neighbours", lambda vectors, k, *rest: calls.append(k) or found(vectors, k, *rest))
    ready = registry.set_up(metrics.catalogue(), [{"local_intrinsic_dimensionality": {"k": [3, 5]}}, {"connected_components": {"k": 2}}])
    assert [r["score"] for r in registry.execute(spark, ready, embedding=rows).collect()] == pytest.approx(alone, rel=1e-12) and calls == [5]
    known = {"beta_0": partial(metrics.connected_components, k=2), "local_intrinsic_dim": partial(metrics.local_intrinsic_dimensionality, k=5)}
    assert [m[2] for m in g.measure(rows, known, list(known))] == pytest.approx([alone[2], alone[1]], rel=1e-12) and calls == [5, 5]


def test_parts_of_a_long_walk_take_few_rounds(spark, monkeypatch):
    """Points in a line with their ids in its order, two lines in a group; a point without others."""
    rows = [("a", i, [1.1 * i + (500.0 if i >= 200 else 0.0)]) for i in range(400)] + [("b", 1, [0.0])]
    cuts = []
    monkeypatch.setattr(g, "cut", lambda df: cuts.append(1) or cut(df))
    got = g.connected_parts(spark.createDataFrame(rows, SCHEMA), 2)
    assert {r["group"]: r["connected_components"] for r in got.collect()} == {"a": 2, "b": 1} and len(cuts) < 41


def test_neighbours_in_waves_leave_nothing_behind(spark, monkeypatch):
    """More tiles than cores go in waves; vectors of which most have more copies than are asked for; no table and no shuffle of a step stays."""
    monkeypatch.setattr(nb, "TILE_BYTES", 1000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)).round(1)
    rows = [("a", i, x[i % 90].tolist()) for i in range(300)] + [("a", 300 + i, x[7].tolist()) for i in range(40)] + [("b", i, [1.5, float(i)]) for i in range(12)]
    before = set(os.listdir(shared_dir(spark)))
    points = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["group"], r["id"], r["other"], r["rank"]) for r in nb.neighbours(points, 5, block=16, fan=4).collect())
    assert got == nearest(rows, 5)
    left = [name for name in set(os.listdir(shared_dir(spark))) - before if re.match("vectors-|cells-|levels-|blocks-", name)]
    assert left == []
    lists = nb.neighbour_lists(points, 5)
    assert sorted((r["group"], r["id"], o, n + 1) for r in lists.collect() for n, o in enumerate(r["others"])) == got


def test_a_cut_leaves_no_shuffle(spark):
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in store.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    before = shuffles()
    few = clean_cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffles() - before and few.count() == 7
