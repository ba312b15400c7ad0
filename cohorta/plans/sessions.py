"""Queries of sessions as recorded: markers, durations, capture starts, logs, seats, gates and the report row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import sessions as se
from cohorta.plans.base import SAMPLES_SQL, samples

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join([SAMPLES_SQL, *ctes])


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(_with("""m AS (SELECT event_id, us // 1000000 AS clock, CASE WHEN event_type = 'view' THEN 'LabExperiment' ELSE 'seat' || seat END AS stream, CASE event_id % 5
  WHEN 0 THEN '{"task":"T' || task || '","phase":"' || event_type || '","wall_clock":' || (us // 60000000) || '}' WHEN 1 THEN '{"task":"T3", broken at t' || task WHEN 2 THEN 'start of t' || task || ' now'
  WHEN 3 THEN props ELSE '{"wall_clock":0,"task":"","participant":"P' || seat || '","event_type":"click"}' END AS v FROM samples)""",
  "p AS (SELECT *, CASE WHEN v LIKE '{%' AND json_valid(v) THEN v ELSE '{}' END AS j FROM m)", "f AS (SELECT *, coalesce(j ->> '$.task', '') AS jt FROM p)")
  + """ SELECT event_id, CAST(CASE WHEN coalesce(j ->> '$.wall_clock', '0') <> '0' THEN j ->> '$.wall_clock' ELSE CAST(clock AS VARCHAR) END AS DOUBLE) AS wall,
  CASE WHEN jt = '' AND stream = 'LabExperiment' THEN CASE WHEN upper(v) LIKE '%T0%' THEN 'T0' WHEN upper(v) LIKE '%T1%' THEN 'T1' WHEN upper(v) LIKE '%T2%' THEN 'T2' WHEN upper(v) LIKE '%T3%' THEN 'T3' WHEN upper(v) LIKE '%T4%' THEN 'T4' ELSE '' END ELSE jt END AS task, coalesce(j ->> '$.phase', '') AS phase, coalesce(j ->> '$.event_type', '') AS event_type, coalesce(j ->> '$.participant', '') AS participant FROM f""")  # fmt: skip
def marker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as markers: payloads, broken payloads, plain words, payloads that say nothing of a task."""
    s, k = samples(spark, sf_dir).drop("participant"), F.col("event_id") % 5
    value = (
        F.when(k == 0, _text('{"task":"T', F.col("task"), '","phase":"', F.col("event_type"), '","wall_clock":', F.floor(F.col("us") / 60_000_000), "}"))
        .when(k == 1, _text('{"task":"T3", broken at t', F.col("task"))).when(k == 2, _text("start of t", F.col("task"), " now"))
        .when(k == 3, F.col("props")).otherwise(_text('{"wall_clock":0,"task":"","participant":"P', F.col("seat"), '","event_type":"click"}'))
    )
    m = s.select("event_id", F.floor(F.col("us") / 1_000_000).alias("clock"), F.when(F.col("event_type") == "view", "LabExperiment").otherwise(_text("seat", F.col("seat"))).alias("stream"), value.alias("v"))
    return se.marker_events(m, "stream", "v", "clock").select("event_id", "wall", "task", "phase", "event_type", "participant")


RUNS_SQL = """e AS (SELECT session, seat, task, CASE WHEN valid THEN us / 1e6 END AS tt FROM samples),
r AS (SELECT session, seat, task, CASE WHEN count(tt) >= 2 AND max(tt) > min(tt) THEN max(tt) - min(tt) END AS s FROM e GROUP BY ALL),
w AS (SELECT session, seat, CASE WHEN count(tt) >= 2 THEN max(tt) - min(tt) END AS s FROM e GROUP BY ALL),
d AS (SELECT session, any_value(runs) AS runs, any_value(total) AS total_s, max(s) FILTER (task = 0) AS T0_s, max(s) FILTER (task = 1) AS T1_s, max(s) FILTER (task = 2) AS T2_s, max(s) FILTER (task = 3) AS T3_s, max(s) FILTER (task = 4) AS T4_s
  FROM r JOIN (SELECT session, count(*) AS runs, coalesce(max(s), 0) AS total FROM w GROUP BY ALL) USING (session) GROUP BY session)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seat's samples as a run of the session's tasks."""
    s = samples(spark, sf_dir).withColumn("wall", F.when(F.col("valid"), F.col("us") / 1e6).otherwise(-1.0)).withColumn("label", _text(" t", F.col("task"), " "))
    return se.run_durations(s, ["session"], "seat", "label", "wall")


@query(_with(RUNS_SQL) + " SELECT session, runs, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("total_s", "T0_s", "T1_s", "T2_s", "T3_s", "T4_s")) + " FROM d")
def run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("session", "runs", *[F.round(c, 6).alias(c) for c in ("total_s", "T0_s", "T1_s", "T2_s", "T3_s", "T4_s")])


@query(_with("o AS (SELECT participant, CASE WHEN event_type = 'signup' THEN 0 WHEN participant % 2 = 0 THEN us / 1e6 ELSE us % 1000 / 10 END AS o, coalesce(x, 0) AS d FROM samples)")
  + """ SELECT participant, 'stream' AS kind, round(greatest(0, arg_max(us, (x, event_id)) - arg_min(us, (x, event_id))) / 1e6, 6) AS duration_s FROM samples WHERE us IS NOT NULL GROUP BY participant
  UNION ALL SELECT participant, 'events', round(CASE WHEN count(*) FILTER (o > 1000000) > 0 THEN greatest(0, greatest(0, max(o + d)) - min(o) FILTER (o > 1000000)) ELSE greatest(0, max(o + d)) END, 6) FROM o GROUP BY participant
  UNION ALL SELECT participant, 'windows', round(sum(coalesce(x, 0)), 6) FROM samples GROUP BY participant""")  # fmt: skip
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of users by the three rules: a stream read in order of value, events with mixed onsets, windows."""
    s = samples(spark, sf_dir).withColumn("at", F.col("us") / 1e6)
    onset = F.when(F.col("event_type") == "signup", 0.0).when(F.col("participant") % 2 == 0, F.col("at")).otherwise(F.col("us") % 1000 / 10)
    parts = {"stream": se.stream_duration(s, ["participant"], ["x", "event_id"], "at"), "events": se.event_duration(s.withColumn("o", onset), ["participant"], "o", "x"), "windows": se.window_total(s, ["participant"], "x")}
    a, b, c = (d.select("participant", F.lit(k).alias("kind"), F.round("duration_s", 6).alias("duration_s")) for k, d in parts.items())
    return a.unionByName(b).unionByName(c)


@query(_with("""e AS (SELECT session, event_id AS line, us // 10000000 AS us, CASE WHEN event_id % 11 > 0 THEN seat END AS device, CASE event_type WHEN 'click' THEN 'capture_started' WHEN 'purchase' THEN 'capture_completed' END AS kind FROM samples)""",
  "s AS (SELECT *, us - lag(us) OVER (PARTITION BY session ORDER BY us) AS gap FROM e WHERE kind = 'capture_started')", "l AS (SELECT session, max(us) AS run FROM s WHERE gap IS NULL OR gap > 86400 GROUP BY session)",
  "b AS (SELECT session, device, max(us) AS start_us, arg_max(line, (us, -line)) AS line FROM s JOIN l USING (session) WHERE us >= run AND device IS NOT NULL GROUP BY ALL)", "z AS (SELECT session, min(start_us) AS first, max(start_us) - min(start_us) AS most FROM b GROUP BY ALL)",
  "c AS (SELECT b.session, b.device, arg_max(e.us, e.line) AS done FROM b JOIN e ON e.session = b.session AND e.device = b.device AND e.kind = 'capture_completed' AND e.line > b.line GROUP BY ALL)")
  + """ SELECT d.session, d.device, start_us, round((start_us - first) / 1000, 6) AS offset_ms, round((done - start_us) / 1e6, 6) AS duration_s, CASE WHEN start_us IS NULL THEN 'No start' WHEN done IS NULL THEN 'Running' ELSE 'Completed' END AS status,
  CASE WHEN most < 100000 THEN 'excellent' WHEN most < 500000 THEN 'good' WHEN most < 1000000 THEN 'acceptable' WHEN most IS NOT NULL THEN 'poor' END AS rating
  FROM (SELECT DISTINCT session, device FROM e WHERE device IS NOT NULL) d LEFT JOIN b ON b.session = d.session AND b.device = d.device LEFT JOIN z ON z.session = d.session LEFT JOIN c ON c.session = d.session AND c.device = d.device""")  # fmt: skip
def capture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats as devices, clicks as starts, purchases as ends; ten days as the gap between runs."""
    kind = F.when(F.col("event_type") == "click", "capture_started").when(F.col("event_type") == "purchase", "capture_completed")
    e = samples(spark, sf_dir).select("session", F.col("event_id").alias("line"), F.floor(F.col("us") / 10_000_000).alias("us"), F.when(F.col("event_id") % 11 > 0, F.col("seat")).alias("device"), kind.alias("kind"))
    r = se.capture_report(e, ["session"], "device", "kind", "us", "line", 86_400)
    return r.withColumn("offset_ms", F.round("offset_ms", 6)).withColumn("duration_s", F.round("duration_s", 6))


@query(_with("t AS (SELECT participant, event_id, t, x, lag(x) OVER (PARTITION BY participant ORDER BY event_id) AS before FROM samples WHERE participant % 3 > 0 AND x IS NOT NULL AND valid)",
  "k AS (SELECT participant, max(event_id) FILTER (x + 150 < before) AS low FROM t GROUP BY ALL)")
  + """ SELECT t.participant, event_id, t, CAST(trunc(x * 1000000) AS BIGINT) AS media_us, 'table' AS source FROM t JOIN k USING (participant) WHERE low IS NULL OR event_id >= low
  UNION ALL SELECT participant, event_id, t, event_id * 1000, 'lines' FROM samples WHERE participant % 2 = 0 AND participant NOT IN (SELECT participant FROM k)""")  # fmt: skip
def preferred_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two users of three have a table, one of two lines."""
    s = samples(spark, sf_dir)
    lines = s.where("participant % 2 = 0").withColumn("media_us", F.col("event_id") * 1000)
    return se.preferred_log(s.where("participant % 3 > 0 and valid"), lines, ["participant"], "event_id", "t", "x", 150.0)


@query(_with("z AS (SELECT participant, quantile_cont(t / 86400 - event_id * 500 / 1e6, 0.5) AS z FROM samples WHERE participant % 3 > 0 AND valid GROUP BY ALL)",
  "f AS (SELECT participant, z, event_id / 10 AS pts, CASE WHEN z IS NOT NULL THEN t / 86400 - event_id / 10 - z WHEN event_type <> 'view' THEN t / 1e5 - event_id / 10 END AS d FROM samples LEFT JOIN z USING (participant))",
  "m AS (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY participant) AS mid, avg(pts) OVER (PARTITION BY participant) AS p FROM f)")
  + """ SELECT participant, CASE WHEN any_value(z) IS NOT NULL THEN 'anchor' WHEN any_value(mid) IS NOT NULL THEN 'frame' END AS method, count(*) AS n, round(CASE WHEN any_value(z) IS NOT NULL THEN any_value(mid) END, 6) AS delay_s, round(quantile_cont(abs(d - mid), 0.5), 6) AS mad_s,
  round(CASE WHEN any_value(z) IS NOT NULL THEN regr_slope(d, pts - p) * 60000 END, 4) AS drift_ms_min, round(CASE WHEN any_value(z) IS NOT NULL THEN -any_value(mid) WHEN any_value(mid) IS NOT NULL THEN 0 END, 6) AS offset_s FROM m GROUP BY participant""")  # fmt: skip
def anchored_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as seconds of a clock; one user of three has no anchor."""
    s = samples(spark, sf_dir).select("participant", "valid", (F.col("t") / 86_400).alias("clock"), F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("t") / 1e5).alias("unix"), (F.col("event_id") / 10).alias("pts"), (F.col("event_id") * 500).alias("media_us"))
    d = se.anchored_delay(s, s.where("participant % 3 > 0 and valid"), ["participant"], "clock", "unix", "pts")
    return d.select("participant", "method", "n", *[F.round(c, k).alias(c) for c, k in (("delay_s", 6), ("mad_s", 6), ("drift_ms_min", 4), ("offset_s", 6))])


@query(_with("w AS (SELECT session, event_id, CASE WHEN event_type = 'error' THEN 'T9' ELSE 'T' || task END AS task, us AS start, us + event_id AS \"end\", CASE WHEN event_type = 'view' THEN x END AS off FROM samples)",
  "o AS (SELECT session, arg_min(off, event_id) FILTER (off IS NOT NULL) AS off FROM w GROUP BY ALL)", "s AS (SELECT DISTINCT session, 'P' || (seat + 1) AS seat, 20 + participant % 50 AS age FROM samples WHERE session % 3 > 0)",
  "l AS (SELECT session, task, max(event_id) AS event_id FROM w WHERE task <> 'T9' GROUP BY ALL)")
  + " SELECT l.session, l.task, w.start, w.\"end\", o.off AS \"offset\", s.seat, s.age FROM l JOIN w USING (event_id) JOIN o ON o.session = l.session LEFT JOIN s ON s.session = l.session")
def seated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as rows of window tables; one session of three has no seat table."""
    s = samples(spark, sf_dir)
    w = s.select("session", "event_id", F.when(F.col("event_type") == "error", "T9").otherwise(_text(" T", F.col("task"))).alias("task"), F.col("us").alias("start"), (F.col("us") + F.col("event_id")).alias("end"), F.when(F.col("event_type") == "view", F.col("x")).alias("offset"))
    seats = s.where("session % 3 > 0").select("session", _text("P", F.col("seat") + 1).alias("seat"), (20 + F.col("participant") % 50).alias("age")).distinct()
    return se.seated_windows(w, seats, ["session"], "event_id", "seat")


@query(_with("p AS (SELECT participant, event_id, row_number() OVER w - 1 AS i, x / 200 AS x, CASE WHEN valid THEN event_id % 100 / 100 END AS y FROM samples WINDOW w AS (PARTITION BY participant ORDER BY us, event_id))",
  "v AS (SELECT *, i = 0 OR coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) * 2 < 0.9, false) AS slow FROM p WINDOW w AS (PARTITION BY participant ORDER BY i))",
  "g AS (SELECT *, i - row_number() OVER (PARTITION BY participant, slow ORDER BY i) AS run FROM v)")
  + " SELECT participant, min(i) AS first, max(i) + 1 AS \"end\", count(*) / 2 * 1000 AS duration_ms, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy, round(max(x) - min(x) + max(y) - min(y), 9) AS dispersion FROM g WHERE slow GROUP BY participant, run HAVING count(*) >= 3")
def screen_fixations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as eyes at 2 Hz on a screen."""
    s = samples(spark, sf_dir).select("participant", "us", "event_id", (F.col("x") / 200).alias("x"), F.when(F.col("valid"), F.col("event_id") % 100 / 100).alias("y"))
    f = se.screen_fixations(s, ["participant"], ["us", "event_id"], "x", "y", 2.0, 0.9)
    return f.select("participant", "first", "end", "duration_ms", *[F.round(c, 9).alias(c) for c in ("cx", "cy", "dispersion")])


@query(_with("j AS (SELECT participant, CASE WHEN valid THEN x END AS px, event_id % 17 AS joint, event_id % 10 / 10 AS conf, x - 150 AS err, event_id % 4 AS cams FROM samples)",
  "f AS (SELECT participant, px IS NOT NULL AS had, joint >= 11 AS off, conf < 0.3::DOUBLE AS low, err > 20 AS high, cams < 2 AS few FROM j)")
  + " SELECT participant, count(*) FILTER (had) AS before, count(*) FILTER (had AND NOT off AND NOT low AND NOT high AND NOT few) AS after, count(*) FILTER (had AND (off OR low OR high OR few)) AS removed, count(*) FILTER (had AND NOT off AND low) AS low_confidence, count(*) FILTER (had AND NOT off AND high) AS high_error, count(*) FILTER (had AND NOT off AND few) AS few_cameras, count(*) FILTER (had AND off) AS off_body FROM f GROUP BY participant")
def joint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s = samples(spark, sf_dir).select("participant", F.when(F.col("valid"), F.col("x")).alias("px"), (e % 17).alias("joint"), (e % 10 / 10).alias("conf"), (F.col("x") - 150).alias("err"), (e % 4).alias("cams"))
    return se.gate_counts(se.gated_joints(s, ["px"], "conf", "err", "cams", "joint", list(range(11))), ["participant"], "px")


_SEATS, _TASKS = range(1, 5), range(5)
_NOTES_SQL = ", ".join([
    "CASE WHEN sdate IS NOT NULL AND date <> sdate THEN 'date mismatch: scheduled ' || sdate || ', actual ' || date END",
    "CASE WHEN nm = 'partial' THEN 'name diff: ' || array_to_string(list_sort(list_concat(list_filter(names, lambda n: NOT list_contains(snames, n)), list_filter(snames, lambda n: NOT list_contains(names, n)))), ', ') WHEN nm = 'mismatch' THEN 'names mismatch vs schedule' END",
    *[f"CASE WHEN streams > 0 AND {c}{s} = 0 THEN 'missing {w} P{s}' END" for s in _SEATS for c, w in (("g", "gaze"), ("h", "physio"))],
    *[f"CASE WHEN session % 3 > 0 AND v{s} IS NULL THEN 'video P{s} unmatched' END" for s in _SEATS],
    "CASE WHEN runs IS NULL THEN 'no experiment events' ELSE 'missing tasks: ' || nullif(concat_ws(',', " + ", ".join(f"CASE WHEN T{t}_s IS NULL THEN 'T{t}' END" for t in _TASKS) + "), '') END",
    "CASE WHEN runs > 1 THEN 'merged from ' || runs || ' runs' END",
])


@query(_with(RUNS_SQL, "s AS (SELECT session, min(us) // 864000000000 AS date, list_sort(list(DISTINCT 'user ' || participant)) AS names FROM samples GROUP BY ALL)",
  "p AS (SELECT session, max(us) // 864000000000 - 30 AS sdate, list_sort(list(DISTINCT 'user ' || CASE WHEN session % 4 = 1 AND seat = 0 THEN -1 WHEN session % 4 = 2 THEN participant + 100000 ELSE participant END)) AS snames FROM samples WHERE session % 5 > 0 GROUP BY ALL)",
  "t AS (SELECT session, seat + 1 AS seat, event_type, max(us) - min(us) AS span FROM samples WHERE event_type <> 'view' OR (session + seat) % 3 > 0 GROUP BY ALL)",
  "f AS (SELECT session, count(*) AS streams, max(span) / 1e6 AS longest_s, count(*) FILTER (event_type = 'view') AS gaze_streams, count(*) FILTER (event_type = 'click') AS sensor_streams, count(*) FILTER (event_type = 'purchase') AS aggregate_streams, count(*) FILTER (event_type = 'signup') AS markers_streams, count(*) FILTER (event_type = 'error') AS other_streams, "
  + ", ".join(f"count(*) FILTER (event_type = 'view' AND seat = {s}) AS g{s}, count(*) FILTER (event_type IN ('click', 'purchase') AND seat = {s}) AS h{s}" for s in _SEATS) + " FROM t GROUP BY ALL)",
  "c AS (SELECT session, " + ", ".join(f"string_agg(r || '(' || mb || 'MB)', ';' ORDER BY r) FILTER (seat = {s}) AS v{s}" for s in _SEATS) + " FROM (SELECT session, seat + 1 AS seat, 'r' || event_id AS r, event_id % 700 AS mb FROM samples WHERE event_type = 'purchase' AND x > 60) GROUP BY ALL)",
  "w2 AS (SELECT *, CASE WHEN sdate IS NULL THEN NULL WHEN names = snames THEN 'yes' WHEN len(list_intersect(names, snames)) > 0 THEN 'partial' WHEN len(names) = 0 THEN 'no_names' ELSE 'mismatch' END AS nm FROM s LEFT JOIN p USING (session) LEFT JOIN f USING (session) LEFT JOIN c USING (session) LEFT JOIN (SELECT * FROM d WHERE session % 6 > 0) USING (session))")
  + " SELECT session, 'g' || session AS grp, CASE WHEN sdate IS NULL THEN NULL WHEN date = sdate THEN 'yes' ELSE 'no' END AS date_match, nm AS names_match, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("streams", "gaze_streams", "sensor_streams", "aggregate_streams", "markers_streams", "other_streams"))
  + ", round(longest_s, 6) AS longest_s, " + ", ".join(f"CASE WHEN streams > 0 THEN CASE WHEN g{s} > 0 THEN 'yes' ELSE 'no' END END AS gaze_P{s}, coalesce(h{s}, 0) AS physio_P{s}, coalesce(v{s}, '') AS video_P{s}" for s in _SEATS)
  + ", concat_ws(';', " + ", ".join(f"CASE WHEN T{t}_s IS NOT NULL THEN 'T{t}' END" for t in _TASKS) + ") AS tasks_found, " + ", ".join(f"round(T{t}_s, 6) AS T{t}_s" for t in _TASKS) + ", round(total_s, 6) AS total_s, concat_ws('; ', " + _NOTES_SQL + ") AS notes FROM w2")
def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of four users: ten-day dates, one session of five not scheduled, one of six without experiment events."""
    s = samples(spark, sf_dir)
    day, name = lambda c: F.floor(c / 864_000_000_000), lambda c: _text(" User  ", c, " ")
    who = F.when((F.col("session") % 4 == 1) & (F.col("seat") == 0), -1).when(F.col("session") % 4 == 2, F.col("participant") + 100_000).otherwise(F.col("participant"))
    group, seat = _text("g", F.col("session")).alias("grp"), _text("P", F.col("seat") + 1).alias("seat")
    sessions = s.groupBy("session", group).agg(day(F.min("us")).alias("date"), F.collect_set(name(F.col("participant"))).alias("names")).withColumn("candidates", F.col("session") % 3)
    plan = s.where("session % 5 > 0").groupBy(group).agg((day(F.max("us")) - 30).alias("date"), F.collect_set(name(who)).alias("names"))
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "gaze", "click", "sensor", "purchase", "aggregate", "signup", "markers", "error", "else")]), F.col("event_type"))
    streams = s.where("event_type != 'view' or (session + seat) % 3 > 0").groupBy("session", kind.alias("kind"), seat).agg(((F.max("us") - F.min("us")) / 1e6).alias("duration_s"))
    clips = s.where("event_type = 'purchase'").select("session", seat, _text("r", F.col("event_id")).alias("recording"), (F.col("event_id") % 700).cast("double").alias("mb"), (F.col("x") > 60).alias("video"))
    r = se.session_rows(sessions, plan, streams, clips, _runs(spark, sf_dir).where("session % 6 > 0"), "session", "grp")
    return r.withColumns({c: F.round(c, 6) for c in ("longest_s", "total_s", *[f"T{t}_s" for t in _TASKS])})
