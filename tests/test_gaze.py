"""Splines against a dense solver, gaze and pupil features by their formulas, warped sequences."""

from __future__ import annotations

import numpy as np
import pytest

from cohorta.operators import gaze, signals, splines


def dense(x, y, at):
    """All cubic pieces from one system: values, equal slopes and curvatures, one cubic over the first and last two pieces."""
    n = len(x) - 1
    rows, right = [], []

    def row(**of):
        r = np.zeros(4 * n)
        for k, v in of.items():
            r[4 * int(k[1:]) : 4 * int(k[1:]) + 4] = v
        return r

    for i in range(n):
        h = x[i + 1] - x[i]
        rows += [row(**{f"p{i}": [1, 0, 0, 0]}), row(**{f"p{i}": [1, h, h**2, h**3]})]
        right += [y[i], y[i + 1]]
        if i < n - 1:
            rows += [row(**{f"p{i}": [0, 1, 2 * h, 3 * h**2], f"p{i + 1}": [0, -1, 0, 0]}), row(**{f"p{i}": [0, 0, 2, 6 * h], f"p{i + 1}": [0, 0, -2, 0]})]
            right += [0, 0]
    rows += [row(**{"p0": [0, 0, 0, 1], "p1": [0, 0, 0, -1]}), row(**{f"p{n - 2}": [0, 0, 0, 1], f"p{n - 1}": [0, 0, 0, -1]})]
    c = np.linalg.solve(np.array(rows), np.array(right + [0, 0])).reshape(n, 4)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 1)
    u = at - x[k]
    return c[k, 0] + c[k, 1] * u + c[k, 2] * u**2 + c[k, 3] * u**3


def test_spline_against_a_dense_solver():
    rng = np.random.default_rng(1)
    for n in (4, 5, 8, 30):
        x = np.sort(rng.choice(60, n, replace=False)).astype(float)
        y, at = rng.normal(size=n), np.linspace(x[0], x[-1], 50)
        assert np.allclose(splines.spline(x, y, at), dense(x, y, at), atol=1e-7)
    x = np.arange(6.0)
    assert np.allclose(splines.spline(x, x**3 - x, np.array([0.5, 3.3])), [0.5**3 - 0.5, 3.3**3 - 3.3])
    assert splines.spline(np.array([0.0, 2, 3]), np.array([0.0, 2, 9]), np.array([1.0])).tolist() == [1]


@pytest.mark.parametrize("block", [4, 512])
def test_gaps(spark, monkeypatch, block):
    monkeypatch.setattr(splines, "BLOCK", block)
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=260))
    gone = np.zeros(260, bool)
    for at, n in ((0, 2), (9, 1), (20, 3), (40, 10), (70, 11), (100, 5), (130, 1), (132, 1), (200, 9), (258, 2)):
        gone[at : at + n] = True
    rows = [("a", i, None if gone[i] else float(y[i])) for i in range(260)] + [(None, i, v) for i, v in enumerate([1.0, None, 3.0, None, None])] + [("none", 0, None)]
    got = {(r["k"], r["i"]): r["filled"] for r in splines.filled_cubic(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v").collect()}
    at = np.arange(260.0)
    want = dense(at[~gone], y[~gone], at)
    for i in range(260):
        stays = i < 2 or i >= 258 or 70 <= i < 81
        assert (got["a", i] is None) if stays else got["a", i] == pytest.approx(want[i], abs=1e-7)
    assert [got[None, i] for i in range(5)] == [1.0, 2.0, 3.0, None, None] and got["none", 0] is None


def test_warped_sequences(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=40)
    assert np.allclose(splines.bent(x, np.random.default_rng(0), 4, 0.0), x)
    many = [splines.bent(np.arange(40.0), np.random.default_rng(i), 4, 0.2) for i in range(200)]
    assert all(abs(m[0]) < 1e-9 and m[-1] == pytest.approx(39) and len(m) == 40 for m in many) and np.std([m[20] for m in many]) > 1
    p = splines.pressed(np.arange(1.0, 41), np.random.default_rng(1), 0.5)
    start = int(np.random.default_rng(1).integers(0, 20))
    assert (p[:start] == np.arange(1, start + 1)).all() and np.allclose(p[start : start + 10], np.linspace(start + 1, start + 20, 10)) and (p[-10:] == 0).all()
    assert (p[start + 10 : 30] == np.arange(start + 21, 41)).all()
    assert splines.pressed(np.ones(8), rng, 0.5).tolist() == [1.0] * 8
    df = spark.createDataFrame([(1, x.tolist()), (2, None), (3, []), (4, [1.0])], "k int, s array<double>")
    a, b = (sorted(map(str, splines.warped(df, "k", "s", 2, "time").collect())) for _ in range(2))
    assert a == b and len(a) == 8
    rows = splines.warped(df, "k", "s", 2, "time").collect()
    assert {len(r["s"]) for r in rows if r["k"] == 1} == {40} and all(r["s"] == [] for r in rows if r["k"] == 3)
    with pytest.raises(ValueError):
        splines.warped(df, "k", "s", 1, "other")


def test_gaze_by_its_formulas(spark):
    rng = np.random.default_rng(5)
    n, rate = 200, 50.0
    x, y = np.clip(np.cumsum(rng.normal(0, 0.002, n)) + 0.5, -0.1, 1.1), np.clip(np.cumsum(rng.choice([0.001, 0.05, -0.05], n)) + 0.5, 0, 1)
    valid = rng.random(n) > 0.1
    rows = [(1, i, float(a), float(b), bool(v)) for i, (a, b, v) in enumerate(zip(x, y, valid))] + [(2, i, 0.1, 0.1, i < 4) for i in range(9)]
    got = {r["k"]: r for r in gaze.gaze_features(spark.createDataFrame(rows, "k int, i int, x double, y double, v boolean"), ["k"], ["i"], "x", "y", "v", rate).collect()}
    xv, yv = x[valid], y[valid]
    speed = np.hypot(np.diff(xv), np.diff(yv)) * rate
    r = got[1]
    assert r["validity"] == pytest.approx(valid.mean()) and r["saccades"] == (speed > 0.1).sum() and r["path"] == pytest.approx(speed.sum() / rate)
    assert r["saccade_speed"] == pytest.approx(speed[speed > 0.1].mean()) and r["saccade_size"] == pytest.approx(speed[speed > 0.1].mean() / rate)
    fix, runs, start = np.concatenate(([True], speed < 0.1)), [], 0
    for i in range(1, len(fix) + 1):
        if i == len(fix) or fix[i] != fix[start]:
            if fix[start] and i - start >= 3:
                runs.append((start, i))
            start = i
    assert r["fixations"] == len(runs) and r["fixation_ms"] == pytest.approx(np.mean([(b - a) / rate * 1000 for a, b in runs]))
    assert r["fixation_spread"] == pytest.approx(np.mean([np.ptp(xv[a:b]) + np.ptp(yv[a:b]) for a, b in runs]))
    entropy = lambda h: -(h[h > 0] / h.sum() * np.log(h[h > 0] / h.sum())).sum()
    assert r["entropy_x"] == pytest.approx(entropy(np.histogram(xv, 10, (0, 1))[0])) and r["entropy_2d"] == pytest.approx(entropy(np.histogram2d(xv, yv, 10, [[0, 1], [0, 1]])[0]))
    quad = (xv > 0.5) * 2 + (yv > 0.5)
    assert r["transitions_s"] == pytest.approx((np.diff(quad) != 0).sum() / (n / rate)) and [r[f"dwell_{q + 1}"] for q in range(4)] == pytest.approx([(quad == q).mean() for q in range(4)])
    assert got[2]["validity"] == pytest.approx(4 / 9) and got[2]["path"] is None and got[2]["fixations"] is None


def test_hulls_in_parts(spark):
    rng = np.random.default_rng(6)
    import pandas as pd

    pdf = pd.DataFrame({"k": rng.integers(0, 2, 3000), "x": rng.normal(size=3000), "y": rng.normal(size=3000)})
    pdf.loc[::50, "x"] = np.nan
    pdf = pd.concat([pdf, pd.DataFrame({"k": [7, 7], "x": [np.nan, 1.0], "y": [0.0, 1.0]})], ignore_index=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r["k"]: r["area"] for r in gaze.hull_areas(spark.createDataFrame(pdf).repartition(3), ["k"], "x", "y").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: pytest.approx(signals.hull_area(part, "x", "y")["area"]) for k, part in pdf.groupby("k")} and got[7] == 0


def test_pupil_by_its_formulas(spark):
    rng = np.random.default_rng(7)
    n, rate = 90, 25.0
    left, right, valid = 3 + np.cumsum(rng.normal(0, 0.02, n)), 3.1 + rng.normal(0, 0.01, n), np.ones(n, bool)
    valid[10:13] = valid[40:41] = valid[88:] = False
    rows = [(1, i, float(a), float(b), bool(v)) for i, (a, b, v) in enumerate(zip(left, right, valid))] + [(2, i, 3.0 + i, 3.0, True) for i in range(6)] + [(3, i, 3.0 + i % 3, 0.1, True) for i in range(12)]
    got = {r["k"]: r for r in gaze.pupil_features(spark.createDataFrame(rows, "k int, i int, l double, r double, v boolean"), ["k"], ["i"], "l", "r", "v", rate).collect()}
    p, r = ((left + right) / 2)[valid], got[1]
    d = np.diff(p)
    assert r["pupil_mean"] == pytest.approx(p.mean()) and r["rmssd"] == pytest.approx(np.sqrt((d**2).mean())) and r["slope"] == pytest.approx(np.polyfit(np.arange(len(p)), p, 1)[0])
    assert r["change_mean"] == pytest.approx(np.abs(d).mean() * rate) and r["change_sd"] == pytest.approx(d.std() * rate) and r["range"] == pytest.approx(np.ptp(p))
    z = (p - p.mean()) / p.std()
    assert r["skewness"] == pytest.approx((z**3).mean()) and r["kurtosis"] == pytest.approx((z**4).mean() - 3)
    assert r["blinks_s"] == pytest.approx(3 / (n / rate)) and r["blink_ms"] == pytest.approx(np.mean([3, 1, 2]) / rate * 1000) and r["between_blinks_s"] == pytest.approx(np.mean([27, 47]) / rate)
    slow = np.empty(len(p))
    for i in range(len(p)):
        a = min(max(i - 10, 0), len(p) - 21)
        slow[i] = np.polyval(np.polyfit(np.arange(21), p[a : a + 21], 3), i - a)
    assert r["fast_share"] == pytest.approx(((p - slow) ** 2).mean() / ((slow**2).mean() + 1e-8), rel=1e-6)
    assert got[2]["pupil_mean"] is None and got[2]["blinks_s"] is None
    assert got[3]["pupil_mean"] == pytest.approx(4.0) and got[3]["right_mean"] is None and got[3]["fast_share"] is None and got[3]["blink_ms"] == 0


def test_hulls_of_many_keys(spark):
    """40,000 keys whose rows lie in all batches, keys of one or two points, without any, and a null key."""
    import time

    df = spark.range(320_000).selectExpr("id * 7919 % 40000 AS k", "sin(id) AS x", "cos(id * 1.7) + sin(id) AS y")
    odd = spark.createDataFrame([(-1, 1.0, 1.0), (-2, 1.0, 2.0), (-2, 3.0, 4.0), (-3, None, 1.0), (-3, float("nan"), 1.0), (None, 0.0, 0.0), (None, 1.0, 0.0), (None, 0.0, 1.0), (None, 0.2, 0.2), (-4, 5.0, 5.0), (-4, 5.0, 5.0), (-4, 6.0, 6.0), (-4, 7.0, 7.0)], "k long, x double, y double")
    start = time.time()
    got = {r["k"]: r["area"] for r in gaze.hull_areas(df.union(odd).repartition(8), ["k"], "x", "y").collect()}
    assert time.time() - start < 30
    assert len(got) == 40_005 and [got[k] for k in (-1, -2, -3, -4)] == [0, 0, 0, pytest.approx(0, abs=1e-12)] and got[None] == pytest.approx(0.5)
    pdf = df.where("k % 1000 = 3").toPandas()
    assert {k: got[k] for k in set(pdf["k"])} == {k: pytest.approx(signals.hull_area(part, "x", "y")["area"]) for k, part in pdf.groupby("k")}
