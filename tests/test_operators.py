"""Edge cases that the tables do not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.functions import scalars as sc
from cohorta.operators import clock, evaluate, features, group, joins, signals, windows
from cohorta.sources import tables
from cohorta.streaming import monitors


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_rolling_windows_only_whole_ones(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in (0, 1, 5, 9, 10)], "k string, us long, x double")
    got = {(r["window"], r["us"]) for r in windows.rolling_windows(df, ["k"], "us", 5, 5).collect()}
    assert got == {(0, 0), (0, 1), (1, 5), (1, 9)}  # 10 opens a window that does not end


def test_range_join_bounds(spark):
    s = spark.createDataFrame([("a", t) for t in (0, 5, 9, 10)], "k string, us long")
    w = spark.createDataFrame([("a", 0, 10), ("a", 5, 5)], "k string, s long, e long")
    assert sorted(r["us"] for r in joins.range_join(s, w, ["k"], "us", "s", "e", 3).collect()) == [0, 5, 9]
    assert sorted(r["us"] for r in joins.range_join(s, w, ["k"], "us", "s", "e", 3, True).collect()) == [0, 5, 5, 9, 10]


def test_nearest_tie_takes_the_earlier(spark):
    left = spark.createDataFrame([("a", 5), ("a", 100), ("b", 1)], "k string, us long")
    right = spark.createDataFrame([("a", 3, 30.0), ("a", 7, 70.0)], "k string, us long, x double")
    got = {(r["k"], r["us"]): (r["near_at"], r["near_value"]) for r in joins.nearest(left, right, ["k"], "us", "x", 50).collect()}
    assert got == {("a", 5): (3, 30.0), ("a", 100): (None, None), ("b", 1): (None, None)}


def test_slope_is_measured_from_the_minimum(spark):
    df = spark.createDataFrame([("a", float(t), 2.0 * t) for t in range(5)], "k string, t double, x double")
    t, x = np.arange(5.0), 2 * np.arange(5.0)
    assert one(features.slope(df, ["k"], "t", "x"))["slope"] == pytest.approx((t * (x - x.mean())).sum() / (t * t).sum())
    assert one(features.slope(df, ["k"], "t", "x", True))["slope"] == pytest.approx(2.0)


def test_calibration_leaves_certainty_out(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False)], "c double, ok boolean")
    assert one(evaluate.calibration_error(df, "c", "ok"))["ece"] == 0.0
    assert one(evaluate.calibration_error(df, "c", "ok", closed=True))["ece"] == pytest.approx(0.5)


def test_temporal_split_refuses_the_first_task(spark):
    with pytest.raises(ValueError):
        evaluate.temporal_split(spark.range(1).withColumn("task", F.lit(0)), "task", 0)


def test_finite(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "s string")
    assert [r[0] for r in df.select(sc.finite(F.col("s"))).collect()] == [1.5, None, None, None, None]


def test_soft_label_adds_up(spark):
    r = one(spark.range(1).select(sc.soft_label(F.lit(5.0), F.lit(1.0), 3.0, 6.0).alias("p")))["p"]
    assert sum(r) == pytest.approx(1) and r == pytest.approx([0.0227501, 0.8185946, 0.1586553], abs=1e-6)


def test_low_pass_keeps_a_constant_and_stops_a_tone():
    assert signals.low_pass(np.full(50, 3.0), 10, 0.5) == pytest.approx(np.full(50, 3.0))
    tone = np.sin(2 * np.pi * 4 * np.arange(200) / 10)
    assert np.abs(signals.low_pass(tone, 10, 0.5)[20:-20]).max() < 0.05


def test_pulse_finds_the_rate(spark):
    t = np.arange(0, 80, 0.04)
    df = spark.createDataFrame([("a", float(x), float(np.sin(2 * np.pi * 1.2 * x))) for x in t], "k string, t double, x double")
    got = one(signals.by_group(df, ["k"], "t", lambda r: signals.spectral_rate(r, "x", 25.0) | signals.pulse(r, "x", 25.0), f"per_minute double, {signals.PULSE_SCHEMA}"))
    assert abs(got["per_minute"] - 72) < 1 and abs(got["rate"] - 72) < 1


def test_triangulation_round_trip(spark):
    rng = np.random.default_rng(1)
    point, cams, seen = np.array([0.3, -0.2, 2.0, 1.0]), [], []
    for k in range(3):
        p = np.hstack((np.eye(3), rng.normal(0, 0.3, (3, 1))))
        u = p @ point
        cams.append((k, p.ravel().tolist()))
        seen.append((1, k, float(u[0] / u[2]), float(u[1] / u[2])))
    got = one(signals.triangulate(spark.createDataFrame(seen, "frame int, camera int, u double, v double"), spark.createDataFrame(cams, "camera int, p array<double>"), ["frame"]))
    assert (got["px"], got["py"], got["pz"]) == pytest.approx((0.3, -0.2, 2.0), abs=1e-6) and got["error"] < 1e-6


def test_linear_fit_without_spread(spark):
    df = spark.createDataFrame([("a", 5.0, 8.0), ("a", 5.0, 8.0)], "k string, x double, y double")
    r = one(clock.linear_fit(df, ["k"], "x", "y"))
    assert (r["scale"], r["offset"], r["residual"]) == (1.0, 3.0, 0.0)


def test_pearson_needs_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert one(df.agg(group.pearson("x", "y").alias("r")))["r"] is None


def test_sample_table_reads_text_and_gzip(spark, tmp_path):
    import gzip

    text = "lsl_time\tvalue_0\n1.0\t2\n2.0\tbad\n"
    (tmp_path / "sub-01_ses-A_task-T1_acq-P2_physio.tsv").write_text(text)
    with gzip.open(tmp_path / "sub-01_ses-A_task-T2_acq-P3_physio.tsv.gz", "wt") as f:
        f.write(text)
    got = sorted(tuple(r) for r in tables.sample_table(spark, str(tmp_path), ["value_0", "value_9"]).na.fill(-1).collect())
    assert got == [(1.0, 2.0, -1.0, "A", "T1", "P2"), (1.0, 2.0, -1.0, "A", "T2", "P3"), (2.0, -1.0, -1.0, "A", "T1", "P2"), (2.0, -1.0, -1.0, "A", "T2", "P3")]
    assert sum(r["files"] for r in tables.inventory(spark, str(tmp_path)).collect()) == 2


def test_annotations_round_trip(spark, tmp_path):
    rows = [("A", "T1", "speech", 0.5, 1.0, "yes"), ("A", "T1", "speech", 2.0, 3.0, "no"), ("A", "T1", "gaze", 0.0, 1.0, "left")]
    df = spark.createDataFrame(rows, "session string, task string, tier string, start double, end double, label string")
    tables.write_annotations(df, str(tmp_path / "a"))
    assert sorted(tuple(r) for r in tables.annotations(spark, str(tmp_path / "a")).collect()) == sorted(rows)


def test_streaming_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(200)], "k int, s long, x double").withColumn("ts", F.timestamp_seconds("s"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = monitors.sliding_features(stream, "ts", "k", "x", "20 seconds", "10 seconds", "1 hour").writeStream.format("memory").queryName("sliding").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = monitors.batch_sliding_features(df, "ts", "k", "x", "20 seconds", "10 seconds")
    assert sorted(map(tuple, spark.table("sliding").collect())) == sorted(map(tuple, want.collect()))


def test_reset_monitor(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 1, 9.0), ("b", 2, 8.9)], "d string, o long, m double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = monitors.reset_monitor(stream, "d", "o", "m", 0.5).writeStream.format("memory").queryName("resets").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("resets").collect()] == [("a", 3, 5.0, 1.0)]


def test_fuzzy_match_meets_every_pair_at_the_cutoff(spark):
    import random

    from cohorta.operators import joins as j

    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            last, row[0] = row[0], i
            for k, y in enumerate(t, 1):
                last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
        return row[-1]

    rnd = random.Random(6)
    right = ["catherine", "", "a", "abcde"] + ["".join(rnd.choices("abc", k=rnd.randint(1, 24))) for _ in range(120)]
    left = ["katherine", "", "a", "xbcde"]
    for b in right[4:]:
        w = list(b)
        for _ in range(rnd.randint(0, max(1, len(b) // 4))):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "z"])
        left.append("".join(w))
    want = {}
    for a in set(left):
        near = [(-(1 - distance(a, b) / max(len(a), len(b), 1)), b) for b in set(right)]
        if (best := min(near))[0] <= -0.8:
            want[a] = (best[1], round(-best[0], 9))
    l = spark.createDataFrame([(x,) for x in sorted(set(left))], "a string")  # noqa: E741
    r = spark.createDataFrame([(x,) for x in sorted(set(right))], "b string")
    got = {x["a"]: (x["b"], round(x["similarity"], 9)) for x in j.fuzzy_match(l, r, "a", "b").collect()}
    assert got == want and got["katherine"][0] == "catherine" and got["xbcde"][0] == "abcde"


def test_drift_anchor_of_short_and_long_streams(spark):
    from cohorta.operators import clock

    rows = [(p, float(t), t - 0.01 * t - 5) for p, n in ((1, 9), (2, 10), (3, 19), (4, 20), (5, 67)) for t in range(n)]
    got = {r["p"]: r for r in clock.drift_anchor(spark.createDataFrame(rows, "p int, c double, m double"), ["p"], "c", "m").collect()}
    assert sorted((p, r["n"]) for p, r in got.items()) == [(2, 10), (3, 19), (4, 20), (5, 67)]
    assert got[3]["slope"] == 0 and abs(got[3]["base"] - 5.09) < 1e-9 and abs(got[5]["slope"] - 0.01) < 1e-9 and abs(got[5]["base"] - 5) < 1e-9
