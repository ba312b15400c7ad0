"""Trial windows, summaries, smoothing and variations against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohorta.operators import trials as tr
from cohorta.operators.signals import low_pass


def test_stimulus_windows_prefer_what_was_shown(spark):
    events = spark.createDataFrame([
        (1, "a", "start", 10.0, 9.0), (2, "a", "Video", None, None), (3, "a", "video", 20.0, 0.2), (4, "a", "video", 30.0, 7.0),
        (1, "b", None, 5.0, None), (2, "b", "end", 6.0, 3.0), (1, "c", "video", None, 2.0), (2, "c", "start", 1.0, 2.0), (1, "d", "start", 4.0, None),
    ], "row int, stim string, flag string, onset double, duration double")
    labels = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5), ("e", 6)], "stim string, id int")
    got = {r["id"]: (r["from"], r["until"]) for r in tr.stimulus_windows(labels, events, ["stim"], "row", "onset", "duration", "flag").collect()}
    assert got == {1: (20.0, 21.0), 2: (20.0, 21.0), 3: (5.0, 8.0), 5: (4.0, 9.0)}
    w = tr.stimulus_windows(labels.where("id = 3"), events, ["stim"], "row", "onset", "duration", "flag")
    at = spark.createDataFrame([("b", float(k)) for k in range(15)], "stim string, t double")
    assert sorted(r["t"] for r in tr.trial_samples(at, w, ["stim"], "t", 2, 1.5).collect()) == [5.0, 6.0, 7.0, 8.0, 9.0]


def test_summaries_carry_values_and_default_to_0(spark):
    rows = [("a", 1, None, None, None), ("a", 2, 3.0, 0.0, 1.0), ("a", 3, None, 4.0, 1.0), ("a", 4, 6.0, None, 0.0), ("b", 1, None, None, None)]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double, v double")
    g = {r["k"]: r for r in tr.gaze_summary(df, ["k"], "i", "x", "y", "v").collect()}
    x, y = np.array([0.5, 3, 3, 6]), np.array([0.5, 0, 4, 4])
    assert np.allclose([g["a"][c] for c in ("x_mean", "x_std", "y_mean", "y_std", "validity_rate", "saccade_proxy")], [x.mean(), x.std(), y.mean(), y.std(), 0.5, np.hypot(np.diff(x), np.diff(y)).mean()])
    assert list(g["b"])[1:] == [0.5, 0.0, 0.5, 0.0, 0.0, 0.0]
    p = {r["k"]: r for r in tr.pupil_summary(df, ["k"], "x", "y", "v").collect()}
    assert (p["a"]["x_mean"], p["a"]["y_mean"], p["a"]["y_std"], p["a"]["blink_rate"]) == (4.5, 4.0, 0.0, 0.5) and np.isclose(p["a"]["pupil_mean"], (3 + 4 + 6) / 3)
    assert list(p["b"])[1:] == [0.0] * 6 + [1.0]
    for width in (1, 3, 4):
        e = {r["k"]: r for r in tr.conductance_summary(df, ["k"], "i", "x", width).collect()}
        raw = np.array([0, 3.0, 3, 6])
        tonic = np.convolve(raw, np.ones(width) / width, "same")
        assert np.allclose(list(e["a"])[1:], [tonic.mean(), tonic.std(), (raw - tonic).mean(), (raw - tonic).std()]) and list(e["b"])[1:] == [0.0] * 4
    m = {r["k"]: r for r in tr.motion_summary(df, ["k"], "i", ["x", "y"], "mag").collect()}
    assert np.isclose(m["a"]["mag_mean"], np.hypot([0, 3, 3, 6], [0, 0, 4, 4]).mean()) and list(m["b"])[1:] == [0.0] * 6


def test_window_tables(spark):
    rows = spark.createDataFrame([(1, " T1 ", "5", "9", ""), (2, "T1", "6", "8", "x"), (3, "T9", "1", "2", "2.5"), (4, None, "1", "2", "3")], "row int, task string, start string, end string, off string").withColumn("s", F.lit(1))
    assert [tuple(r) for r in tr.task_bounds(rows, ["s"], "row", "task", "start", "end", ["T0", "T1"]).collect()] == [(1, "T1", 6.0, 8.0)]
    assert tr.first_offset(rows, ["s"], "row", "off").first()["off"] == 2.5
    assert tr.first_offset(rows.where("row < 3"), ["s"], "row", "off").first()["off"] is None


def test_tracks_are_smoothed_in_long_whole_runs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 60)
    gone = {0, 20, 25}  # runs of 19, 4 and 34 frames
    rows = [("j", i, None if i in gone else float(v), None if i in gone else float(-v)) for i, v in enumerate(x)] + [("q", 7, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double").repartition(5)
    got = {(r["k"], r["i"]): (r["x"], r["y"]) for r in tr.smoothed_tracks(df, ["k"], "i", ["x", "y"], 30.0).collect()}
    want = x.copy()
    for a, b in ((1, 20), (26, 60)):
        want[a:b] = low_pass(x[a:b], 30.0, 6.0)
    assert len(got) == 61 and got["q", 7] == (1.0, 2.0) and all(got["j", i] == (None, None) for i in gone)
    kept = [i for i in range(60) if i not in gone]
    assert np.allclose([got["j", i][0] for i in kept], want[kept]) and np.allclose([got["j", i][1] for i in kept], -want[kept])
    assert np.std(want[26:]) < np.std(x[26:])


def test_variations_repeat_and_stay_near(spark):
    x = np.sin(np.arange(200) / 9)
    df = spark.createDataFrame([(1, x.tolist()), (2, x.tolist()), (3, []), (4, None)], "k int, s array<double>")
    read = lambda parts: {(r["k"], r["copy"]): r["s"] for r in tr.augmented(df.repartition(parts), "k", "s", 3).collect()}
    a = read(1)
    assert a == read(4) and len(a) == 12 and a[3, 1] == [] and a[4, 2] is None
    assert len({tuple(a[k, c]) for k in (1, 2) for c in (1, 2, 3)}) == 6
    for k in (1, 2):
        for c in (1, 2, 3):
            y = np.array(a[k, c])
            best = max(np.corrcoef(np.roll(y, -d), x)[0, 1] for d in range(-20, 21))
            assert best > 0.98 and 0.8 < y.std() / x.std() < 1.2
    plain = tr.augmented(df, "k", "s", 1, noise=0.0, scale=(1.0, 1.0), shift=0).where("k = 1").first()["s"]
    assert np.allclose(plain, x)
