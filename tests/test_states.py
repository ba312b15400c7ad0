"""Operators against known values and brute force: posterior, pulse, thresholds, names, gestures, splits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.functions import scalars as sc
from cohorta.operators import evaluate as ev
from cohorta.operators import signals
from cohorta.operators import states as st


def dense_posterior(t, seen_t, seen_y, noise, mean, rate, sd):
    if not len(seen_t):
        return np.full(len(t), mean), np.full(len(t), sd)
    k = lambda a, b: sd**2 * np.exp(-rate * np.abs(a[:, None] - b[None, :]))
    solve = np.linalg.solve(k(seen_t, seen_t) + np.diag(noise**2), np.column_stack((seen_y - mean, k(seen_t, t))))
    cross = k(t, seen_t)
    return mean + cross @ solve[:, 0], np.sqrt(np.maximum(sd**2 - np.einsum("ij,ji->i", cross, solve[:, 1:]), 1e-12))


@pytest.mark.parametrize("n, m", [(0, 5), (1, 1), (30, 40), (30, 0)])
def test_posterior_in_two_passes(n, m):
    rng = np.random.default_rng(n)
    seen, t = np.round(rng.uniform(0, 20, n), 1), np.round(rng.uniform(-5, 25, m), 1)  # with equal times
    y, noise = rng.normal(5, 2, n), rng.uniform(0.5, 3, n)
    got, want = signals.gaussian_posterior(t, seen, y, noise, 5.0, 0.3, 2.0), dense_posterior(t, seen, y, noise, 5.0, 0.3, 2.0)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_posterior_of_tables_with_empty_sides(spark):
    q = spark.createDataFrame([(1, 0.0), (1, 2.0), (2, 1.0)], "k int, t double").repartition(4)
    o = spark.createDataFrame([(1, 1.0, 7.0, 1.0), (3, 1.0, 7.0, 1.0)], "k int, t double, y double, noise double")
    for queries, seen in ((q, o), (q.where("k = 0"), o), (q, o.where("k = 0"))):
        got = sorted(map(tuple, signals.process_posterior(queries, seen, ["k"], 5.0, 0.3, 2.0).collect()))
        assert [x[:2] for x in got] == sorted(map(tuple, queries.collect()))
        assert all(abs(x[2] - 5) > 0.1 if x[0] == 1 and seen is o else x[2:] == (5.0, 2.0) for x in got)


def test_left_out_posterior(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(t), float(y)) for k in range(3) for t, y in zip(np.sort(rng.uniform(0, 30, 8)), rng.normal(5, 2, 8))] + [(9, 1.0, 1.0)]
    got = {(r["k"], r["t"]): (r["mu"], r["sigma"]) for r in st.left_out_posterior(spark.createDataFrame(rows, "k int, t double, y double"), ["k"], "t", "y", 5.0, 0.2, 2.0, 1.2).collect()}
    assert len(got) == 24
    for k, t, _ in rows[:-1]:
        other = np.array([(b, c) for a, b, c in rows if a == k and b != t])
        m, s = dense_posterior(np.array([t]), other[:, 0], other[:, 1], np.full(7, 1.2), 5.0, 0.2, 2.0)
        assert np.allclose(got[k, t], (m[0], s[0]))


def test_peaks_on_plateaus_and_pulse():
    assert signals.peaks(np.array([0, 1, 3, 3, 0, 2, 2, 2, 1.0]), 1, 0.5) == [3, 7]
    import pandas as pd

    t = np.arange(0, 60, 1 / 25)
    row = signals.pulse(pd.DataFrame({"x": np.sin(2 * np.pi * 1.2 * t)}), "x", 25.0, 72.0)
    assert abs(row["rate"] - 72) < 2 and row["pnn50"] <= 100 and row["quality"] > 0.9


def test_tertiles_of_one_large_cluster(spark):
    rows = [(1, x) for x in [3.0] * 2 + [7.0] * 10 + [9.0]] + [(2, 5.0)] * 6 + [(3, x) for x in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)] + [(4, None)]
    got = {r["k"]: (r["t1"], r["t2"]) for r in ev.tertile_thresholds(spark.createDataFrame(rows, "k int, x double"), ["k"], "x").collect()}
    # Both bounds of the first fall in one cluster: t2 moves half way from 5 to the first value above 5.5.
    assert got == {1: (5.0, 6.0), 2: (4.5, 5.5), 3: (2.5, 4.5)}


def test_names_and_ages(spark):
    rows = [("Tobii_P1", "gaze", "tobii", "P1"), ("my_tobii", "x", "tobii", None), ("x", "Markers", "markers", None), ("study_a", "", "markers", None), ("ffmpeg-cam", "", "sync", None), ("a", "clock", "sync", None), ("markers", "x", "other", None), ("tablet 3", None, "other", "P3"), ("stop12", None, "other", None), (None, None, "other", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "name string, kind string")
    got = df.select(sc.stream_kind(F.col("name"), F.col("kind"), "study_").alias("k"), sc.seat_of(F.col("name")).alias("s")).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]
    keys = {"ffmpeg_progress_Jabra-PanaCast-20-cam1-vid-x": "jabra_panacast_20_cam1_vid", "acq-Mic..2": "mic_2", "DPA-a-b-aud": "dpa_a_b_aud", " X  Y ": "x_y", None: ""}
    got = spark.createDataFrame([(k,) for k in keys], "n string").select(sc.canonical_key(F.col("n"))).collect()
    assert [r[0] for r in got] == list(keys.values())
    ages = [("29.0", None, 29), (" 31 ", "65+", 31), ("n/a", "25-34", 29), (None, "65+", 65), ("x", "about 25-34", None), (None, None, None)]
    got = spark.createDataFrame([a[:2] for a in ages], "e string, b string").select(sc.age_years(F.col("e"), F.col("b"))).collect()
    assert [r[0] for r in got] == [a[2] for a in ages]


def test_gesture_flags(spark):
    names = ["nose", "mid_hip", *[f"{s}_{p}" for s in ("left", "right") for p in ("shoulder", "elbow", "wrist")]]
    at = {n: (0.0, 0.0, 0.0) for n in names} | {"mid_hip": (0.0, -5.0, 0.0), "left_shoulder": (1.0, 0.0, 0.0), "left_elbow": (0.5, 0.0, 0.0), "right_wrist": (3.0, 0.0, 0.0), "right_elbow": (1.5, 0.0, 0.0)}
    cols = {n: [F.lit(v) for v in at[n]] for n in names}
    out = sc.gesture_flags(cols, {n: F.lit(1.0) for n in names}, 0.5, 0.2, 0.2, 0.95)
    r = spark.range(1).select(*[c.alias(n) for n, c in out.items()]).first().asDict()
    assert r == {"left_head": True, "left_chest": False, "left_stretched": True, "right_head": False, "right_chest": False, "right_stretched": True, "both_head": False}
    unsure = sc.gesture_flags(cols | {"nose": [F.lit(None).cast("double")] * 3}, {n: F.lit(0.1 if n == "right_elbow" else 1.0) for n in names}, 0.5, 0.2, 0.2, 0.95)
    r = spark.range(1).select(*[c.alias(n) for n, c in unsure.items()]).first().asDict()
    assert not r["left_head"] and r["left_stretched"] and not r["right_stretched"]


def test_bootstrap_and_split(spark):
    df = spark.range(3000).selectExpr("id % 3 AS y", "CASE WHEN id % 10 < 8 THEN id % 3 ELSE (id + 1) % 3 END AS p", "id % 97 AS s")
    r = ev.bootstrap(df, "y", "p", 3, seed=1).first()
    assert 0.77 < r["low"] < 0.8 < r["high"] < 0.83 and ev.bootstrap(df, "y", "p", 3, seed=1).first() == r
    roles = ev.subject_split(df, "s", 0.2, 0.1, 5).groupBy("role").agg(F.countDistinct("s").alias("n")).collect()
    assert {r["role"]: r["n"] for r in roles} == {"test": 19, "val": 9, "train": 69}


def test_zero_and_missing_cases(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None), (2, 5.0), (2, 7.0)], "k int, x double")
    got = sorted(((r["k"], r["x"], r["scaled"]) for r in st.unit_scaled(df, ["k"], "x").collect()), key=str)
    assert got == sorted([(1, 2.0, 0.0), (1, 2.0, 0.0), (2, None, None), (2, 5.0, 0.0), (2, 7.0, 1.0)], key=str)
    p = st.process_parameters(df.withColumn("t", F.lit(1.0)), ["k"], "t", "x", (0.03, 4.0, 5.0)).first()
    assert tuple(p) == (0, 0.03, 4.0, 5.0)
