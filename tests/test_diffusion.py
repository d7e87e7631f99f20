"""PHATE against dense NumPy, with and without landmarks."""

import numpy as np

from lumenfold.operators import diffusion as df_
from lumenfold.operators import geometry

SCHEMA = "group string, id int, state array<double>"


def dense_kernel(x, k, alpha, looked):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    order = [sorted((d[i, j], j) for j in range(n) if j != i)[:looked] for i in range(n)]
    out = np.eye(n)
    for i in range(n):
        e = order[i][min(k, len(order[i])) - 1][0] if order[i] else 0
        for dist, j in order[i]:
            w = 1.0 if dist == 0 else float(np.exp(-((dist / e) ** alpha))) if e > 0 else 0.0
            if w >= df_.LEAST:
                out[i, j] += w / 2
                out[j, i] += w / 2
    return out


def tree(n, seed):
    """Points along three branches."""
    rng = np.random.default_rng(seed)
    t, arm = rng.random(n), rng.integers(0, 3, n)
    return np.eye(5)[arm] * t[:, None] * 4 + rng.normal(size=(n, 5)) * 0.05


def test_phate_of_small_groups(spark):
    x, y = tree(70, 1), tree(25, 2)
    y[5] = y[6] = y[7]
    rows = [("x", i, v.tolist()) for i, v in enumerate(x)] + [("y", 3 * i, v.tolist()) for i, v in enumerate(y)] + [("one", 1, [1.0] * 5), ("two", 1, [1.0]), ("two", 2, [2.0]), ("x", 900, None), (None, 1, [1.0] * 5)]
    got = {}
    for r in df_.phate(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 10.0, 6).collect():
        got.setdefault(r["group"], {})[r["id"]] = r["projected"]
    assert {g: len(v) for g, v in got.items()} == {"x": 70, "y": 25, "one": 1, "two": 2} and got["one"][1] == [0.0, 0.0]
    for name, points, step in (("x", x, 1), ("y", y, 3)):
        kernel = dense_kernel(points, 4, 10.0, 12)
        want = df_.potential(kernel / kernel.sum(1, keepdims=True), 6)
        found = np.array([got[name][i * step] for i in range(len(points))])
        assert np.allclose(found, df_.scaled(want, 2), atol=1e-6)


def test_phate_by_landmarks(spark):
    x = tree(240, 3)
    frame = spark.createDataFrame([("x", i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    kernel = dense_kernel(x, 5, 10.0, 15)
    p = kernel / kernel.sum(1, keepdims=True)
    marks = {r["id"]: r["mark"] for r in df_.landmarks(frame, 30).collect()}
    c = np.zeros((240, 30))
    c[list(marks), list(marks.values())] = 1
    assert len(marks) == 240 and (c.sum(0) > 0).all()
    out = c.T @ kernel
    between = (out / out.sum(1, keepdims=True)) @ (p @ c)
    want = (p @ c) @ df_.scaled(df_.potential(between, 5), 2)
    got = np.array([r["projected"] for r in sorted(df_.phate(frame, 5, 10.0, 5, most=30).collect(), key=lambda r: r["id"])])
    assert np.allclose(got, want, atol=1e-6)
    # Neighbourhoods of a tree survive in two dimensions.
    drawn = spark.createDataFrame([("x", i, v.tolist()) for i, v in enumerate(got)], SCHEMA)
    assert geometry.preserved(frame, drawn, 10).first()["trustworthiness"] > 0.85


def test_products(spark):
    rng = np.random.default_rng(4)
    a, b = (rng.random((6, 6)) * (rng.random((6, 6)) < 0.4) for _ in range(2))
    cells = lambda m: spark.createDataFrame([("g", int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "group string, a long, b long, p double")
    got = np.zeros((6, 6))
    for r in df_.product(cells(a), cells(b)).collect():
        got[r["a"], r["b"]] = r["p"]
    assert np.allclose(got, a @ b)
    assert df_.phate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scaling():
    rng = np.random.default_rng(5)
    y = rng.normal(size=(40, 2))
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    out = df_.scaled(d, 2)
    assert np.allclose(np.sqrt(((out[:, None] - out[None]) ** 2).sum(-1)), d, atol=1e-6)
    assert df_.scaled(np.zeros((3, 3)), 2).tolist() == [[0.0, 0.0]] * 3


def test_product_sends_rows_once_a_block(spark, monkeypatch):
    """Blocks and rounds much smaller than a group; entries without a partner, a null group, a group that one side lacks."""
    monkeypatch.setattr(df_, "PAIRS", 50)
    rng = np.random.default_rng(4)
    x, y = ((rng.random((60, 60)) < 0.1) * rng.random((60, 60)) for _ in range(2))
    frame = lambda m, g: [(g, int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]  # noqa: B905, E731
    schema = "group string, a long, b long, p double"
    left = spark.createDataFrame(frame(x, "s") + frame(x[:3], "t") + frame(x[:3], None), schema)
    right = spark.createDataFrame(frame(y, "s") + frame(y[:3], "u") + frame(y[:3], None), schema)
    made = df_.product(left, right, block=8)
    got = made.collect()
    want = x @ y
    assert {r["group"] for r in got} == {"s"} and len(got) == np.count_nonzero(want)
    assert all(abs(r["p"] - want[r["a"], r["b"]]) < 1e-12 for r in got)
    assert "CoGroup" in made._jdf.queryExecution().executedPlan().toString()
