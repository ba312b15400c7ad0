"""Run catalogue, window dataset and fold scores against small known cases and brute force."""

from __future__ import annotations

import numpy as np
import pytest

from cohorta.operators import dataset as ds


def test_task_runs(spark):
    root = "x/sub-1/ses-a/"
    files = ["audio/s_task-T1_run-01_aud.wav", "audio/s_task-T1_run-01_aud.txt", "video/s_task-T1_run-01_acq-b_video.mkv", "et/s_task-T1_run-01_acq-P1_tobii.mp4", "et/s_task-T1_run-01_gaze.tsv", "et/P1_task-T1_gaze.ndjson",
             "beh/s_task-T1_run-01_events.tsv", "physio/s_task-T1_run-01_p.tsv.gz", "annot/s_task_run_windows.tsv", "participant_map.tsv", "mocap/gestures_events.ndjson", "beh/s_task-T2_run-01_events.tsv", "audio/s_audio.wav"]
    r = ds.task_runs(spark.createDataFrame([(root + f,) for f in files + files[:1]] + [(None,), ("other/y.wav",)], "path string"), "path").collect()
    assert len(r) == 1
    got = {k: [p.removeprefix(root) for p in v] if isinstance(v, list) else v.removeprefix(root) for k, v in r[0].asDict().items()}
    assert got == {
        "sub": "sub-1", "ses": "ses-a", "task": "T1", "run": "01", "audio": files[:1], "video": [files[3], files[2]], "events": files[6], "gaze": [files[4], files[5]],
        "physio": [files[7]], "windows": files[8], "participant_map": files[9], "gestures": files[10],
    }
    assert ds.task_runs(spark.createDataFrame([], "path string"), "path").count() == 0


def test_window_dataset(spark):
    reports = spark.createDataFrame([(1, 7, 10, 5), (2, 7, 100, 6), (3, 8, 10, 7)], "id int, k int, t long, rating int")
    rows = spark.createDataFrame([(7, 0, 1.0), (7, 5, None), (7, 5, 2.0), (7, 10, 6.0), (7, 11, 9.0), (8, 10, 4.0)], "k int, t long, v double")
    said = spark.createDataFrame([(7, -5, 3), (7, 8, 20), (8, 20, 30)], "k int, s long, e long")
    traits = spark.createDataFrame([(7, 0.5)], "k int, trait double")
    got = {r["id"]: r for r in ds.window_dataset(reports, rows, said, traits, ["k"], "id", "t", "v", ("s", "e"), 10, 5).collect()}
    assert set(got) == {1, 3}
    r = got[1]
    assert (r["n"], r["mean"], r["min"], r["max"], r["speech"], r["trait"], r["rating"], r["sequence"]) == (3, 3.0, 1.0, 6.0, 5, 0.5, 5, [1.0, 1.5, 2.0, 4.0, 6.0])
    assert r["slope"] == pytest.approx(np.polyfit([0, 5, 10], [1, 2, 6], 1)[0])
    assert (got[3]["n"], got[3]["sd"], got[3]["speech"], got[3]["trait"], got[3]["sequence"]) == (1, None, 0, None, [4.0] * 5)


def test_fold_scores(spark):
    rng = np.random.default_rng(0)
    y = np.arange(60) % 3
    x = y[:, None] * [4.0, -4.0] + rng.normal(0, 0.3, (60, 2))
    df = spark.createDataFrame([(i // 20, float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(60)] + [(0, None, 1.0, 0)], "f int, a double, b double, y int")
    got = {r["fold"]: (r["n"], r["macro_f1"]) for r in ds.fold_scores(df, "f", ["a", "b"], "y").collect()}
    assert got == {k: (20, 1.0) for k in range(3)}
    # Pool rows of the test's own fold are not learnt from; those of training folds are.
    wrong = spark.createDataFrame([(0, float(x[i, 0]), float(x[i, 1]), int(y[i] + 1) % 3, 50.0) for i in range(60)], "f int, a double, b double, y int, weight double")
    with_pool = {r["fold"]: r["macro_f1"] for r in ds.fold_scores(df, "f", ["a", "b"], "y", wrong).collect()}
    assert with_pool[0] == 1.0 and with_pool[1] < 0.1 and with_pool[2] < 0.1
    one = {r["fold"]: (r["n"], r["macro_f1"]) for r in ds.fold_scores(df.where("f = 1"), "f", ["a", "b"], "y").collect()}
    assert one == {1: (20, 0.0)}
    assert ds.fold_scores(df.where("f = 9"), "f", ["a", "b"], "y").count() == 0
    with pytest.raises(ValueError):
        ds.fold_scores(df, "f", ["a"], "y", most=2)


def test_window_pool(spark):
    from cohorta.operators import dataset

    windows = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 5, 15), ("b", 0, 0, 10)], "k string, w int, s long, e long")
    one = spark.createDataFrame([("a", t, float(t)) for t in (0, 4, 6, 9, 10)] + [("a", 7, None), ("b", 1, 1.0)], "k string, at long, v double")
    two = spark.createDataFrame([("a", 5, 2.0), ("a", 6, 4.0), ("a", 14, 9.0), ("b", 5, 1.0)], "k string, at long, v double")
    got = {(r["k"], r["w"]): r for r in dataset.window_pool(windows, {"x": (one, "v"), "y": (two, "v")}, ["k"], "w", "s", "e", "at", 3, least=2).collect()}
    assert set(got) == {("a", 0), ("a", 1)}
    r = got["a", 0]
    assert (r["x_n"], r["x_mean"], r["x_min"], r["x_max"], r["y_n"]) == (4, 4.75, 0.0, 9.0, 2) and abs(r["x_slope"] - 1) < 1e-9 and r["y_sequence"] == [2.0, 3.0, 4.0]
    assert got["a", 1]["x_n"] == 3 and got["a", 1]["y_n"] == 3
    assert dataset.window_pool(windows.limit(0), {"x": (one, "v")}, ["k"], "w", "s", "e", "at", 3).count() == 0
