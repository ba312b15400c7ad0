"""Ridge, transfer, peaks, track repair and start shifts against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.operators import models as mod


def ridge(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    s = np.where(s > 1e-9, s, 1.0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + (q - m) / s @ w


def left_out_error(x, y, alpha):
    """Squares of the errors at each row from all others, on features standardised by all."""
    z = (x - x.mean(0)) / x.std(0)
    e = 0.0
    for i in range(len(x)):
        k = np.arange(len(x)) != i
        a, c = np.column_stack((np.ones(k.sum()), z[k])), np.diag([0.0] + [alpha] * x.shape[1])
        e += (y[i] - np.concatenate(([1.0], z[i])) @ np.linalg.solve(a.T @ a + c, a.T @ y[k])) ** 2
    return e


def test_left_out_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(50, 3, (40, 3))
    y = x @ [0.5, -0.2, 0.0] + rng.normal(0, 2, 40)
    f = rng.integers(0, 5, 40)
    df = spark.createDataFrame([(i, int(f[i]), *map(float, x[i]), float(y[i])) for i in range(40)] + [(99, 0, None, 1.0, 1.0, 1.0)], "id int, f int, a double, b double, c double, y double")
    alphas = (0.1, 1.0, 10.0, 100.0)
    got = {r["id"]: r["predicted"] for r in mod.left_out_ridge(df, "f", ["a", "b", "c"], "y", alphas).collect()}
    assert set(got) == set(range(40))
    for k in range(5):
        tx, ty = x[f != k], y[f != k]
        model = ridge(tx, ty, min(alphas, key=lambda a: left_out_error(tx, ty, a)))
        assert np.allclose([got[i] for i in np.where(f == k)[0]], model(x[f == k]), atol=1e-6)
    none = mod.left_out_ridge(df.where("id < 0"), "f", ["a", "b", "c"], "y")
    assert none.count() == 0 and mod.left_out_ridge(df.where("f = 1"), "f", ["a"], "y").where("predicted is not null").count() == 0
    with pytest.raises(ValueError):
        mod.left_out_ridge(df, "id", ["a"], "y", most=10)


def test_robust_ridge(spark):
    rng = np.random.default_rng(2)
    x, y = rng.gamma(2, 3, (30, 2)), rng.uniform(1, 9, 30)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(30)] + [(99, None, 1.0, 5.0)], "id int, a double, b double, y double")
    z = (x - np.median(x, 0)) / (np.percentile(x, 75, 0) - np.percentile(x, 25, 0))
    c = z - z.mean(0)
    want = np.clip(y.mean() + c @ np.linalg.solve(c.T @ c + np.eye(2), c.T @ (y - y.mean())), 1, 9)
    got = {r["id"]: r["predicted"] for r in mod.robust_ridge(df, df, ["a", "b"], "y").collect()}
    assert np.allclose([got[i] for i in range(30)], want) and got[99] is None
    assert mod.robust_ridge(df.where("id < 0"), df, ["a"], "y").where("predicted is null").count() == 31


def test_knn_labels(spark):
    rng = np.random.default_rng(3)
    x, c, q = rng.integers(0, 6, (40, 2)).astype(float), rng.integers(0, 3, 40), rng.integers(0, 6, (25, 2)).astype(float)
    lab = spark.createDataFrame([(i, *map(float, x[i]), int(c[i])) for i in range(40)], "k int, a double, b double, y int")
    pool = spark.createDataFrame([(i, *map(float, q[i])) for i in range(25)] + [(99, None, 1.0)], "id int, a double, b double")
    got = {r["id"]: (r["label"], r["confidence"]) for r in mod.knn_labels(pool, lab, "k", ["a", "b"], "y").collect()}
    m, s = x.mean(0), x.std(0)
    for i in range(25):
        d = np.sqrt((((x - m) / s - (q[i] - m) / s) ** 2).sum(1))
        near = sorted(range(40), key=lambda j: (d[j], j))[:7]
        w = {j: float(d[j] == 0) if d[near[0]] == 0 else 1 / d[j] for j in near}
        votes = [sum(w[j] for j in near if c[j] == y) for y in range(3)]
        assert got[i][1] == pytest.approx(max(votes) / sum(votes)) and votes[got[i][0]] == pytest.approx(max(votes))
    assert got[99] == (None, None)
    assert mod.knn_labels(pool, lab.limit(7), "k", ["a", "b"], "y").where("label is not null").count() == 0
    with pytest.raises(ValueError):
        mod.knn_labels(pool, lab, "k", ["a", "b"], "y", most=39)


def test_highest_peaks():
    assert mod.highest_peaks(np.array([0, 1, 0, 3, 3, 3, 0, 2, 0.0]), 1, 1.0) == [1, 4, 7]
    assert mod.highest_peaks(np.array([0, 1, 0, 3, 3, 3, 0, 2, 0.0]), 4, 0.0) == [4]
    assert mod.highest_peaks(np.array([0, 2, 0, 2, 0.0]), 3, 0.0) == [3]
    assert mod.highest_peaks(np.array([5, 1, 1]), 1, 0.0) == [] and mod.highest_peaks(np.array([]), 1, 0.0) == []


def test_response_events(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, None, 0.5, 0.0], 0.25, 100.0), (2, None, None, 0.0), (3, [], 0.0, 0.0)], "w int, x array<double>, b double, s double")
    assert [tuple(r) for r in mod.response_events(df, "x", "b", "s", 1.0).select("w", "at", "amplitude").orderBy("at").collect()] == [(1, 98.5, 0.75), (1, 100.5, 0.25)]


def test_too_fast(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, None if rng.random() < 0.2 else float(rng.choice([0, 5, 100]))) for k in range(3) for i in range(60)]
    got = {(r["k"], r["i"]): r["rejected"] for r in mod.too_fast(spark.createDataFrame(rows, "k int, i int, x double"), ["k"], "i", ["x"], 10.0).collect()}
    for k in range(3):
        v = [(i, x) for a, i, x in rows if a == k and x is not None]
        gone: set[int] = set()
        for (i, x), (j, y) in zip(v, v[1:]):
            if i not in gone and abs(y - x) / (j - i) > 10:
                gone.add(j)
        assert {i for (a, i), r in got.items() if a == k and r} == gone and gone


def test_start_delta(spark):
    rng = np.random.default_rng(5)
    raw = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (60, 2)))]
    live = [(1, i + 3, x, y) for _, i, x, y in raw[10:40]]
    s = "k int, t int, x double, y double"
    a, b = spark.createDataFrame(raw, s), spark.createDataFrame(live, s)
    for first in (None, 25):
        assert [tuple(r) for r in mod.start_delta(a, b, ["k"], "t", "x", "y", 5, 1, first=first).collect()] == [(1, 3, 0.0)]
    assert mod.start_delta(a.limit(19), b, ["k"], "t", "x", "y", 5, 1).count() == 0


def test_rebinned(spark):
    df = spark.createDataFrame([(5.0, 2.0), (1.0, 0.5), (None, 1.0)], "m double, s double")
    got = [(r["m"], r["s"], r["soft"], r["hard"]) for r in mod.rebinned(df, "m", "s", 4.0, 6.0).collect()]
    cdf = lambda z: (1 + math.erf(z / math.sqrt(2))) / 2
    for m, s, soft, hard in got:
        if m is None:
            assert hard is None
            continue
        low, up = cdf((4 - m) / s), cdf((6 - m) / s)
        assert np.allclose(soft, [low, up - low, 1 - up], atol=1e-6) and hard == int(np.argmax([low, up - low, 1 - up]))


def test_rate_direction(spark):
    x = [60, 61, 62, 63, 64, None, 50, 45, 40, 35, 1.0]
    df = spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(x)] + [(2, i, 60.0) for i in range(10)], "k int, i int, v double")
    got = {(r["k"], r["bin"]): (r["center_s"], r["shift"]) for r in mod.rate_direction(df, ["k"], "i", "v", 1.0).collect()}
    y = [64.0, 50, 45, 40, 35]
    assert set(got) == {(1, 0), (1, 1)} and got[1, 0] == (2.5, pytest.approx(-0.2))
    assert got[1, 1] == (7.5, pytest.approx(min(1.5, -np.polyfit(range(5), y, 1)[0] / 5)))
    assert df.where(F.col("k") == 2).count() == 10
