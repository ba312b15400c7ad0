"""Eye-tracking rows and small reports by hand."""

from __future__ import annotations

import math

import pytest

from cohorta.operators import eyes


def test_eye_row_by_hand(spark):
    step = 20_000  # 50 Hz
    rows = []
    for i in range(2000):
        blink = i % 500 in range(100, 106)  # six samples: 0.1 s from first to last
        rows.append((1, i * step, 0.5 + 0.01 * (i % 2), 0.5, 3.0, None if i % 4 == 0 else 3.2, not blink))
    rows += [(2, 0, 2.0, 0.5, None, None, True), (2, 100_000, 0.5, 0.5, None, 12.0, True)] + [(3, 5, 0.1, 0.1, 1.0, 1.0, False)]
    got = {r["k"]: r for r in eyes.eye_row(spark.createDataFrame(rows, "k int, us long, x double, y double, l double, r double, v boolean"), ["k"], "us", "x", "y", "l", "r", "v").collect()}
    r = got[1]
    assert r["rate_hz"] == pytest.approx(50) and r["duration_s"] == pytest.approx(39.98) and r["gaze_valid"] == pytest.approx(1 - 24 / 2000)
    assert r["speed_mean"] == pytest.approx(0.5) and r["dispersion"] == pytest.approx(0.005, abs=1e-4) and r["gaze_out"] == 0
    assert r["blinks"] == 4 and r["blink_s"] == pytest.approx(0.1) and r["blinks_min"] == pytest.approx(4 / (39.98 / 60))
    assert r["pupil_mean"] == pytest.approx((3.0 + 3 * 3.1) / 4) and r["pupil_missing"] == 0 and r["right_missing"] == 0.25 and r["eyes_apart"] == pytest.approx(0.2) and r["pupil_range"] == pytest.approx(0.1)
    assert r["pupil_speed"] == pytest.approx(0.1 / 0.02 * 999 / 1999, rel=1e-2) and r["qc"] == "pupil_velocity_spike"
    assert got[2]["qc"] == "short_duration;sample_rate_unavailable;pupil_low_coverage;pupil_left_low_coverage;pupil_right_low_coverage;pupil_implausible;blink_rate_unusual;gaze_out_of_bounds"
    assert got[3]["duration_s"] is None and got[3]["gaze_x_mean"] is None and got[3]["blinks"] == 0 and "gaze_low_validity" in got[3]["qc"]


def test_progress_and_weights(spark):
    rows = [("a", 1, 0.0, 0, 1), ("a", 2, 2.5, 3, None), ("a", 3, 2.0, 4, None), ("b", 1, 7.0, None, 2)]
    got = {r["k"]: tuple(r)[1:] for r in eyes.progress_counts(spark.createDataFrame(rows, "k string, i int, m double, d int, u int"), ["k"], ["i"], "m", "d", "u").collect()}
    assert got == {"a": (3, False, 2.5, 4, 0), "b": (1, True, 0.0, 0, 2)}
    w = eyes.cut_weights(spark.createDataFrame([(1, y) for y in (1, 1, 2, 4, 4, None)], "k int, y int"), ["k"], "y", 5).orderBy("cut").collect()
    assert [(r["cut"], r["positive"], r["weight"]) for r in w] == [(1, 3, pytest.approx(2 / 3)), (2, 2, 1.5), (3, 2, 1.5), (4, 0, 4.0)]


def test_left_out_scores(spark):
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    rows = [(2.0, 4.0, 1.5), (9.0, 7.0, 0.5), (4.5, 4.5, 100.0)]
    for (y, mu, sigma), r in zip(rows, sorted(eyes.left_out_scores(spark.createDataFrame(rows, "y double, mu double, sigma double"), 3.0, 6.0).collect(), key=lambda r: rows.index((r["y"], r["mu"], r["sigma"])))):
        soft = [cdf((3 - mu) / sigma), cdf((6 - mu) / sigma) - cdf((3 - mu) / sigma), 1 - cdf((6 - mu) / sigma)]
        hard, best = 0 if y <= 3 else 1 if y <= 6 else 2, soft.index(max(soft))
        assert r["soft"] == pytest.approx(soft, abs=1e-6) and r["hard"] == hard and r["brier"] == pytest.approx(sum((s - (k == hard)) ** 2 for k, s in enumerate(soft)) / 3, abs=1e-6)
        if sigma < 100:  # the third row's lower and upper mass are equal
            assert r["predicted"] == best and r["correct"] == (best == hard) and r["top"] == pytest.approx(max(soft), abs=1e-6)


def test_turns(spark):
    rows = [("s", 1, "P1", "uncertain"), ("s", 2, "P1", None), ("s", 3, "P2", "sure"), ("s", 4, "P1", "uncertain"), ("s", 5, "P2", "sure")]
    got = {r["who"]: tuple(r)[2:] for r in eyes.speaker_turns(spark.createDataFrame(rows, "s string, t int, who string, c string"), ["s"], ["t"], "who", "c").collect()}
    assert got == {"P1": (3, 1, 0.6667), "P2": (2, 2, 0.0)}
