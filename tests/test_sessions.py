"""Sessions as recorded, by hand: edges that the tables do not have."""

from __future__ import annotations

import pytest

from cohorta.operators import sessions as se


def test_markers(spark):
    rows = [
        (1, "Experiment", '{"task": "T2", "phase": "end", "wall_clock": 12.5, "participant": "P1"}', 3.0),
        (2, "Experiment", '{"phase": "T1"}', 4.0), (3, "Experiment", "t3 and T1", 5.0), (4, "other", "T1", 6.0), (5, None, None, None),
        (6, "Experiment", '{"task": "T2", cut', 7.0), (7, "x", '["T0"]', 8.0), (8, "x", '{"wall_clock": "soon", "task": null}', 9.0), (9, "x", "", 1.0),
    ]
    got = {r["i"]: (r["wall"], r["task"], r["phase"], r["event_type"], r["participant"]) for r in se.marker_events(spark.createDataFrame(rows, "i int, s string, v string, c double"), "s", "v", "c").collect()}
    assert got[1] == (12.5, "T2", "end", "", "P1") and got[2] == (4.0, "T1", "T1", "", "") and got[3] == (5.0, "T1", "", "", "") and got[4] == (6.0, "", "", "", "")
    assert got[5] == (None, "", "", "", "") and got[6] == (7.0, "T2", "", "", "") and got[7] == (8.0, "", "", "", "") and got[8] == (None, "", "", "", "") and got[9][0] == 1.0


def test_durations(spark):
    rows = [("s", 1, " t0 ", 10.0), ("s", 1, "T0", 14.0), ("s", 1, "T1", 20.0), ("s", 1, "T1", -1.0), ("s", 2, "T0", 100.0), ("s", 2, "T0", 103.0), ("s", 2, None, 130.0), ("z", 1, "T0", None), ("q", 1, "T2", 5.0), ("q", 1, "T2", 5.0)]
    got = {r["k"]: r for r in se.run_durations(spark.createDataFrame(rows, "k string, run int, task string, wall double"), ["k"], "run", "task", "wall").collect()}
    assert (got["s"]["runs"], got["s"]["total_s"], got["s"]["T0_s"], got["s"]["T1_s"]) == (2, 30.0, 4.0, None)
    assert (got["z"]["total_s"], got["z"]["T0_s"], got["q"]["T2_s"], got["q"]["total_s"]) == (0.0, None, None, 0.0)
    s = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, 2.0), (1, 4, 9.5), (2, 1, 7.0), (2, 2, 3.0), (3, 1, None)], "k int, i int, t double")
    assert {r["k"]: r["duration_s"] for r in se.stream_duration(s, ["k"], ["i"], "t").collect()} == {1: 4.5, 2: 0.0, 3: None}
    e = spark.createDataFrame([(1, 0.0, 2.0), (1, 2e6, 5.0), (1, 2e6 + 10, 1.0), (2, 3.0, 4.0), (2, None, 20.0), (3, None, None)], "k int, o double, d double")
    assert {r["k"]: r["duration_s"] for r in se.event_duration(e, ["k"], "o", "d").collect()} == {1: 11.0, 2: 20.0, 3: 0.0}


def test_capture_report(spark):
    m = 1_000_000
    rows = [("a", "c1", "capture_started", 0, 1), ("a", "c1", "capture_completed", 50 * m, 2), ("a", "c1", "capture_started", 300 * m, 3), ("a", None, "capture_started", 900 * m, 4), ("a", "c1", "capture_started", 1000 * m, 5)]
    rows += [("a", "c1", "capture_started", 1001 * m, 6), ("a", "c2", "capture_started", 1001 * m + 400_000, 7), ("a", "c1", "capture_completed", 1100 * m, 8), ("a", "c1", "capture_completed", 1200 * m, 9), ("a", "c3", "other", 1, 10), ("b", "c1", "capture_completed", 5, 1)]
    got = {(r["k"], r["d"]): tuple(r)[2:] for r in se.capture_report(spark.createDataFrame(rows, "k string, d string, e string, us long, line int"), ["k"], "d", "e", "us", "line").collect()}
    assert got[("a", "c1")] == (1001 * m, 0.0, 199.0, "Completed", "good") and got[("a", "c2")] == (1001 * m + 400_000, 400.0, None, "Running", "good")
    assert got[("a", "c3")] == (None, None, None, "No start", "good") and got[("b", "c1")] == (None, None, None, "No start", None)
    s = lambda *us: spark.createDataFrame([(1, u) for u in us], "k int, us long")
    at = lambda *us: se.latest_run(s(*us), ["k"], "us", 100).first()["run_us"]
    assert at(0, 100, 200) == 0 and at(0, 101, 200) == 101 and at(5, 99, 100, 199, 200, 500) == 500 and at(7) == 7


def test_logs_and_delays(spark):
    t = spark.createDataFrame([("a", 1, 1.0, 0.0), ("a", 2, 2.0, 1.0), ("a", 3, 3.0, 0.6), ("a", 4, None, 0.0), ("a", 5, 4.0, 0.05), ("a", 6, 5.0, 1.25), ("b", 1, None, 1.0)], "k string, i int, c double, m double")
    j = spark.createDataFrame([("a", 1, 9.0, 9), ("b", 1, 8.0, 7), ("c", 1, 7.0, None)], "k string, i int, c double, media_us long")
    got = sorted(tuple(r) for r in se.preferred_log(t, j, ["k"], "i", "c", "m").collect())
    assert got == [("a", 5, 4.0, 50_000, "table"), ("a", 6, 5.0, 1_250_000, "table"), ("b", 1, 8.0, 7, "lines"), ("c", 1, 7.0, None, "lines")]
    f = spark.createDataFrame([(k, 10.0 + p + 0.001 * p + d, 0.0 if k == "n" else 50.0 + p, p) for k in "ifn" for p, d in ((0.0, 0.0), (1.0, 0.0), (2.0, 0.0))], "k string, c double, u double, p double")
    a = spark.createDataFrame([("i", 10.0, 0), ("i", 11.0, 1_500_000), ("i", 9.7, None)], "k string, c double, media_us long")
    got = {r["k"]: r for r in se.anchored_delay(f, a, ["k"], "c", "u", "p").collect()}
    assert got["i"]["method"] == "anchor" and got["i"]["delay_s"] == pytest.approx(0.251) and got["i"]["offset_s"] == pytest.approx(-0.251) and got["i"]["drift_ms_min"] == pytest.approx(60.0) and got["i"]["mad_s"] == pytest.approx(0.001)
    assert tuple(got["f"])[1:] == ("frame", 3, None, 0.0, None, 0.0) and tuple(got["n"])[1:] == (None, 3, None, None, None, None)


def test_seats_fixations_and_gate(spark):
    w = spark.createDataFrame([(1, 1, "T9", 0, 1, 2.5), (1, 2, "T0", 5, 6, 3.5), (1, 3, " T0", 7, 8, None), (2, 1, "T1", 1, 2, None)], "s int, i int, task string, start int, end int, offset double")
    p = spark.createDataFrame([(1, "P1", 30, 9), (1, "P2", 40, 9)], "s int, seat string, age int, start int")
    assert sorted((tuple(r) for r in se.seated_windows(w, p, ["s"], "i", "seat").collect()), key=str) == [(1, "T0", 7, 8, 2.5, "P1", 30), (1, "T0", 7, 8, 2.5, "P2", 40), (2, "T1", 1, 2, None, None, None)]
    xs = [0.0, 0.01, 0.02, 0.9, 0.91, 0.92, None, 0.5, 0.5, 0.5, 0.5]
    f = se.screen_fixations(spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(xs)], "i int, x double, y double").selectExpr("1 k", "*"), ["k"], ["i"], "x", "y", 5.0)
    assert [(r["first"], r["end"], r["duration_ms"]) for r in f.orderBy("first").collect()] == [(0, 3, 600.0), (8, 11, 600.0)]
    j = spark.createDataFrame([(1, 0, 1.0, 0.9, -1.0, 2), (1, 0, 1.0, 0.1, 25.0, 1), (1, 5, 1.0, 0.1, 1.0, 2), (1, 0, None, 0.1, 99.0, 0), (1, 0, 1.0, None, 20.0, 2)], "k int, joint int, px double, conf double, err double, cams int")
    assert tuple(se.gate_counts(se.gated_joints(j, ["px"], "conf", "err", "cams", "joint", [0, 1]), ["k"], "px").first()) == (1, 4, 2, 2, 1, 1, 1, 1)


def test_session_row(spark):
    s = spark.createDataFrame([("s1", "g1", "d1", ["Ann  Lee", "bo "], 2), ("s2", "g2", "d1", None, 0), ("s3", "g9", "d1", ["x"], 0)], "session string, grp string, date string, names array<string>, candidates int")
    plan = spark.createDataFrame([("g1", "d2", ["ann lee", "cy"]), ("g2", "d1", ["bo"])], "grp string, date string, names array<string>")
    st = spark.createDataFrame([("s1", "gaze", "P1", 5.0), ("s1", "sensor", "P2", 7.5), ("s1", None, None, None)], "session string, kind string, seat string, duration_s double")
    rec = spark.createDataFrame([("s1", "b", "P1", 2.5, True), ("s1", "a", "P1", 7.2, True), ("s1", "c", "P2", 1.0, False)], "session string, recording string, seat string, mb double, video boolean")
    ev = spark.createDataFrame([("s1", r, "T0", w) for r in (1, 2) for w in (1.0, 3.0)], "session string, run int, task string, wall double")
    got = {r["session"]: r for r in se.session_rows(s, plan, st, rec, se.run_durations(ev, ["session"], "run", "task", "wall"), "session", "grp", seats=("P1", "P2")).collect()}
    r = got["s1"]
    assert (r["date_match"], r["names_match"], r["streams"], r["other_streams"], r["longest_s"], r["gaze_P1"], r["gaze_P2"], r["physio_P2"], r["video_P1"], r["tasks_found"], r["total_s"]) == ("no", "partial", 3, 1, 7.5, "yes", "no", 1, "a(7MB);b(3MB)", "T0", 2.0)
    assert r["notes"] == "date mismatch: scheduled d2, actual d1; name diff: bo, cy; missing physio P1; missing gaze P2; video P2 unmatched; missing tasks: T1,T2,T3,T4; merged from 2 runs"
    assert (got["s2"]["names_match"], got["s2"]["gaze_P1"], got["s2"]["notes"]) == ("no_names", None, "no experiment events")
    assert (got["s3"]["date_match"], got["s3"]["names_match"], got["s3"]["streams"], got["s3"]["video_P1"]) == (None, None, 0, "")
