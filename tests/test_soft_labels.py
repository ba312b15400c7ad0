"""Soft labels against a dense solver that takes each window by itself."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.operators import soft_labels as soft

DIMS = [soft.Dimension("v", 5.3, 0.05, 2.1, 0.1, "direction"), soft.Dimension("a", 4.9, 0.5, 1.8, 0.2, "response"), soft.Dimension("d", 5.1, 0.1, 1.9)]


def cdf(z):
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def dense(t, obs, d):
    if not obs:
        return d.mean, math.sqrt(d.variance)
    at, y, s = (np.array(x, float) for x in zip(*obs))
    k = d.variance * np.exp(-d.rate * np.abs(at[:, None] - at)) + np.diag(s**2)
    c = d.variance * np.exp(-d.rate * np.abs(t - at))
    return d.mean + c @ np.linalg.solve(k, y - d.mean), math.sqrt(max(d.variance - c @ np.linalg.solve(k, c), 0))


def agreement(reports, prior):
    out = {}
    for place in {r[:2] for r in reports}:
        own = {s: sorted(r for r in reports if r[:2] == place and r[2] == s) for s in {r[2] for r in reports if r[:2] == place}}
        for k in own:
            for l in own:  # noqa: E741
                if k < l:
                    pairs = [(a, min((b for b in own[l] if abs(b[3] - a[3]) < 90), key=lambda b: b[3], default=None)) for a in own[k]]
                    pairs = [p for p in pairs if p[1]]
                    for i, d in enumerate(DIMS):
                        rho = prior(place[1], d.name)
                        if len(pairs) >= 3:
                            xy = [(a[4 + i], b[4 + i]) for a, b in pairs]
                            known = not any(v is None for p in xy for v in p) and len({p[0] for p in xy}) > 1 and len({p[1] for p in xy}) > 1
                            c = np.corrcoef(*np.array(xy, float).T)[0, 1] if known else 0
                            rho = min(c, 0.95) if c > 0 else 0.05
                        out[(*place, k, l, d.name)] = out[(*place, l, k, d.name)] = rho
    return out


def brute(windows, reports, responses, directions, prior, absent):
    rho_of, out, alone = agreement(reports, prior), {}, {d.name: [] for d in DIMS}
    for s, task, seat, w, t in windows:
        if t is None:
            continue
        mine = [r for r in reports if r[:3] == (s, task, seat)]
        others = sorted({r[2] for r in reports if r[:2] == (s, task)} - {seat})
        for i, d in enumerate(DIMS):
            if d.name in absent.get(task, ()):
                out[w, d.name] = (None, None, (1 / 3,) * 3, 0.0, 0, 0, 0)
                continue
            rho = {o: rho_of.get((s, task, seat, o, d.name), prior(task, d.name)) for o in others}
            own = [(r[3], r[4 + i], 0.8) for r in mine if r[4 + i] is not None]
            cross = [(r[3], r[4 + i], min(max(1.2 / max(rho[o], 0.05), 0.5), 4)) for o in others for r in reports if r[:3] == (s, task, o) and r[4 + i] is not None]
            extra = []
            for o in others:
                if d.evidence and rho[o] >= 0.1:
                    own_windows = sorted((x for x in windows if x[:3] == (s, task, o) and x[4] is not None), key=lambda x: (x[4], x[3]))
                    near = [x for x in own_windows if abs(x[4] - t) <= 45] or own_windows[:3]
                    for x in near:
                        for e in responses if d.evidence == "response" else directions:
                            if e[:4] == x[:4]:
                                if d.evidence == "response":
                                    extra.append((e[4], min(max(d.mean + 2 * math.sqrt(d.variance), 1), 9), min(max((0.8 if e[5] > 0.2 else 1.4) / rho[o], 0.5), 4)))
                                else:
                                    extra.append((e[4], min(max(d.mean + e[5], 1), 9), min(max(1.8 / rho[o], 1), 5)))
            mu, sd = dense(t, own + cross + extra, d)
            alone[d.name].append(dense(t, own, d)[1])
            w_own = max((math.exp(-d.rate * abs(t - r[3])) for r in mine), default=0)
            w_cross = max((math.exp(-d.rate * abs(t - r[3])) for r in reports if r[:2] == (s, task) and r[2] != seat), default=0)
            mean = sum(rho.values()) / len(rho) if rho else 0
            weight = min(max(min(max(w_own + mean * w_cross * 0.6, 0), 0.95), d.least_weight), 0.95)
            out[w, d.name] = (mu, sd, None, weight, len(own), len(cross), len(extra))
    for (w, name), (mu, sd, soft_, *rest) in out.items():
        if mu is not None:
            s = max(sd * min(max(1 + (sd - 0.8) / np.percentile(alone[name], 95), 1), 2.5), 1e-4)
            low, up = cdf((3 - mu) / s), cdf((6 - mu) / s)
            out[w, name] = (mu, sd, (low, up - low, 1 - up), *rest)
    return out


def data(seed):
    rng = random.Random(seed)
    seats = ["P1", "P2", "P3", "P4"]
    value = lambda: rng.choice([None, *map(float, range(1, 10))]) if rng.random() < 0.1 else float(rng.randint(1, 9))
    reports, windows = [], []
    for task in ("T0", "T1", "T4"):
        for seat in seats[: 4 if task != "T4" else 2]:
            times = rng.sample(range(0, 3000), rng.randint(0, 6))
            reports += [("s", task, seat, float(t), value(), value(), value()) for t in times]
        windows += [("s", task, seat, 0, float(rng.randint(-200, 3200))) for seat in seats for _ in range(rng.randint(0, 5))]
    windows = [(*w[:3], i, w[4]) for i, w in enumerate(windows)] + [("s", "T0", "P1", 999, None), ("z", "T9", "P1", 998, 1.0)]
    timed = [w for w in windows if w[4] is not None]
    responses = [(*w[:4], w[4] + rng.uniform(-15, 15), rng.uniform(0.05, 0.4)) for w in timed for _ in range(rng.randint(0, 2))]
    directions = [(*w[:4], w[4] + rng.uniform(-15, 15), rng.uniform(-1.5, 1.5)) for w in timed for _ in range(rng.randint(0, 2))]
    return windows, reports, responses, directions


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_dense_solver(spark, seed):
    windows, reports, responses, directions = data(seed)
    key = "session string, task string, seat string"
    dfs = [
        spark.createDataFrame(windows, f"{key}, window long, t double"), spark.createDataFrame(reports, f"{key}, t double, v double, a double, d double"),
        spark.createDataFrame(responses, f"{key}, window long, at double, amplitude double"), spark.createDataFrame(directions, f"{key}, window long, at double, shift double"),
    ]
    prior = F.when(F.col("dim") == "a", soft.by_name({"T0": 0.2}, F.col("task"), 0.35)).otherwise(soft.by_name({"T0": 0.07}, F.col("task"), 0.25))
    rows = soft.soft_labels(*dfs, DIMS, prior, absent={"T4": ["d"]}).collect()
    plain = lambda task, dim: (0.2 if task == "T0" else 0.35) if dim == "a" else (0.07 if task == "T0" else 0.25)
    want = brute(windows, reports, responses, directions, plain, {"T4": ["d"]})
    got = {(r["window"], r["dim"]): r for r in rows}
    assert len(rows) == len(got) == len(want)
    for k, (mu, sd, label, weight, *n) in want.items():
        r = got[k]
        assert (r["n_own"], r["n_other"], r["n_evidence"]) == tuple(n), k
        assert r["mu"] == pytest.approx(mu, abs=1e-7) and r["sigma"] == pytest.approx(sd, abs=1e-7), k
        assert r["weight"] == pytest.approx(weight) and r["soft"] == pytest.approx(label, abs=1e-6), k
    assert any(n for *_, n in want.values()) and any(w[5] for w in want.values())


def test_no_reports(spark):
    key = "session string, task string, seat string"
    empty = lambda more: spark.createDataFrame([], f"{key}, {more}")
    windows = spark.createDataFrame([("s", "T0", "P1", 1, 5.0)], f"{key}, window long, t double")
    rows = soft.soft_labels(windows, empty("t double, v double, a double, d double"), empty("window long, at double, amplitude double"), empty("window long, at double, shift double"), DIMS, F.lit(0.2)).collect()
    assert {r["dim"]: (r["mu"], round(r["sigma"] ** 2, 9), r["weight"]) for r in rows} == {d.name: (d.mean, d.variance, d.least_weight) for d in DIMS}


def test_many_windows_at_one_time(spark):
    """3,000 windows of each of two seats: the label of a time is worked out once, equal evidence as one observation of less noise."""
    import time

    n, key = 3000, ["s", "T0"]
    reports = spark.createDataFrame([(*key, "P1", 9.0, 5.0, 4.0, 3.0), (*key, "P2", 11.5, 7.0, 8.0, None)], "session string, task string, seat string, t double, v double, a double, d double")
    windows = spark.range(2 * n).selectExpr("'s' AS session", "'T0' AS task", "if(id % 2 = 0, 'P1', 'P2') AS seat", "id AS window", "10.0D AS t")
    responses = windows.drop("t").selectExpr("*", "10.25D AS at", "0.3D AS amplitude")
    start = time.time()
    rows = soft.soft_labels(windows, reports, responses, windows.drop("t").selectExpr("*", "10.25D AS at", "0.3D AS shift").limit(0), DIMS, F.lit(0.4)).collect()
    assert len(rows) == 2 * n * len(DIMS) and len({(r["window"], r["dim"]) for r in rows}) == len(rows) and time.time() - start < 90
    one = [r for r in rows if r["dim"] == "a" and r["seat"] == "P1"]
    assert {r["n_evidence"] for r in one} == {n} and len({(r["mu"], r["sigma"]) for r in one}) == 1
    mu, sd = dense(10.0, [(9.0, 4.0, 0.8), (11.5, 8.0, 3.0), (10.25, DIMS[1].mean + 2 * math.sqrt(DIMS[1].variance), 0.8 / 0.4 / math.sqrt(n))], DIMS[1])
    assert one[0]["mu"] == pytest.approx(mu, abs=1e-7) and one[0]["sigma"] == pytest.approx(sd, abs=1e-7)
