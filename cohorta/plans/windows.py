"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import features as feat
from cohorta.operators import windows as win
from cohorta.plans.base import DAY_US, SAMPLES_SQL, samples

QUERIES, ORACLE_SQL = {}, {}
WIDTH, STEP = 3 * DAY_US, DAY_US


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join([SAMPLES_SQL, *ctes])


WINDOWS_SQL = f"""bounds AS (SELECT *, min(us) OVER (PARTITION BY participant) AS first, max(us) OVER (PARTITION BY participant) AS last FROM samples),
rolled AS (SELECT b.*, CAST(w AS BIGINT) AS window_no FROM bounds b, unnest(range(0, greatest(0, (last - first - {WIDTH}) // {STEP} + 1))) u(w)
  WHERE last - first >= {WIDTH} AND us - first >= w * {STEP} AND us - first < w * {STEP} + {WIDTH})"""


@query(_with(WINDOWS_SQL, """f AS (SELECT session, participant, window_no, count(x) AS n, avg(x) AS mean, quantile_cont(x, 0.95) AS p95, stddev_pop(x) AS sd FROM rolled GROUP BY ALL)""")
       + """ SELECT session, participant, window_no AS "window", n, round(mean, 9) AS mean, round(p95, 9) AS p95, round(sd, 9) AS sd,
  round(coalesce(CASE WHEN stddev_samp(mean) OVER p > 0 THEN (mean - avg(mean) OVER p) / stddev_samp(mean) OVER p END, 0), 9) AS z,
  round(avg(mean) OVER (PARTITION BY session, window_no), 9) AS group_mean FROM f WINDOW p AS (PARTITION BY participant)""")  # fmt: skip
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each user's rolling windows, their z within the user, and the group's mean."""
    rolled = win.rolling_windows(samples(spark, sf_dir), ["participant"], "us", WIDTH, STEP)
    f = rolled.groupBy("session", "participant", "window").agg(*[c for c, n in zip(feat.basic("x"), range(8)) if n in (0, 2, 4, 6)])
    out = f.withColumn("z", win.z_within("mean", ["participant"])).withColumn("group_mean", F.expr("avg(mean) OVER (PARTITION BY session, window)"))
    return out.select("session", "participant", "window", "n", *[F.round(c, 9).alias(c) for c in ("mean", "p95", "sd", "z", "group_mean")])


TASKS_SQL = """task_rows AS (SELECT session, task,
  coalesce(min_by(us, event_id) FILTER (WHERE event_type = 'signup'), min_by(us, event_id)) AS start_us,
  max_by(us, event_id) FILTER (WHERE event_type = 'purchase') AS finish_us, max_by(us, event_id) AS last_us FROM samples GROUP BY ALL),
tasks AS (SELECT * FROM (SELECT session, task, start_us, coalesce(finish_us, lead(start_us) OVER (PARTITION BY session ORDER BY start_us, task), last_us) AS end_us FROM task_rows) WHERE end_us > start_us)"""


def _tasks(s: DataFrame) -> DataFrame:
    return win.task_windows(s, "session", "task", "event_type", "us", "event_id", "signup", "purchase")


@query(_with(TASKS_SQL) + " SELECT session, task, start_us, end_us FROM tasks")
def task_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(samples(spark, sf_dir))


@query(_with(TASKS_SQL, "ends AS (SELECT session, min(us) AS first_us, max(us) AS last_us FROM samples GROUP BY ALL)",
  """gaps AS (SELECT session, 'BREAK_' || task || '_' || lead(task) OVER w AS name, end_us AS from_us, lead(start_us) OVER w AS to_us FROM tasks WINDOW w AS (PARTITION BY session ORDER BY start_us, task)
  UNION ALL SELECT t.session, 'PRE', first_us, min(start_us) FROM tasks t JOIN ends USING (session) GROUP BY t.session, first_us
  UNION ALL SELECT t.session, 'POST', max(end_us), last_us FROM tasks t JOIN ends USING (session) GROUP BY t.session, last_us)""") + " SELECT * FROM gaps WHERE to_us > from_us")  # fmt: skip
def break_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return win.break_windows(_tasks(s), s.groupBy("session").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us")), "session")


@query(_with(TASKS_SQL, f"""each AS (SELECT s.session, s.task, s.us, start_us, (end_us - start_us + 1000 - {DAY_US}) // {DAY_US // 2} AS last FROM samples s JOIN (SELECT session, start_us, end_us, task FROM tasks) t USING (session, task) WHERE us >= start_us AND us < end_us),
  r AS (SELECT session, task, us, w AS window_no FROM each, unnest(range(0, greatest(0, last + 1))) u(w) WHERE us - start_us >= w * {DAY_US // 2} AND us - start_us < w * {DAY_US // 2} + {DAY_US})""")
  + """ SELECT session, task, CAST(window_no AS BIGINT) AS "window", count(*) AS n, min(us) AS first_us, max(us) AS last_us, CAST(sum(us) // count(*) AS BIGINT) AS centre FROM r GROUP BY ALL HAVING count(*) >= 5""")
def task_anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-day steps of one-day windows from each task's start, of five samples or more."""
    s = samples(spark, sf_dir).withColumn("us", F.col("us"))
    w = win.task_anchored_windows(s, _tasks(s), ["session", "task"], "us", DAY_US, DAY_US // 2, 5, bucket=5 * DAY_US, short=True)
    return w.select("session", F.col("task"), "window", "n", "first_us", "last_us", F.col("centre_us").alias("centre"))


RUNS_SQL = """marked AS (SELECT *, CASE WHEN lag(valid) OVER w IS NOT DISTINCT FROM valid AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM samples WINDOW w AS (PARTITION BY participant ORDER BY us)),
run_rows AS (SELECT *, sum(c) OVER (PARTITION BY participant ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM marked)"""


@query(_with(RUNS_SQL) + " SELECT participant, CAST(run AS BIGINT) AS run, bool_and(valid) AS state, count(*) AS n, min(us) AS start, max(us) AS \"end\" FROM run_rows GROUP BY participant, run")
def validity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.runs(samples(spark, sf_dir), ["participant"], "us", "valid")


@query(_with(RUNS_SQL) + f" SELECT participant, CAST(run AS BIGINT) AS run, count(*) AS n, min(us) AS start, max(us) AS \"end\" FROM run_rows GROUP BY participant, run HAVING NOT bool_or(valid) AND max(us) - min(us) BETWEEN 1 AND {DAY_US}")
def blinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two invalid samples or more within a day."""
    return win.blinks(samples(spark, sf_dir), ["participant"], "us", "valid", 1, DAY_US)


@query(_with("""v AS (SELECT *, (us - lag(us) OVER w) / 1e6 AS dt, abs(x - lag(x) OVER w) AS d, valid AND lag(valid) OVER w AS ok FROM samples WINDOW w AS (PARTITION BY participant ORDER BY us))""")
  + " SELECT participant, task, round(avg(CASE WHEN ok AND dt > 0 THEN 1e6 * d / dt END), 4) AS speed_mean, round(quantile_cont(CASE WHEN ok AND dt > 0 THEN 1e6 * d / dt END, 0.95), 4) AS speed_p95 FROM v GROUP BY ALL")
def gaze_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = win.velocity(samples(spark, sf_dir), ["participant"], "us", ["x"], "valid")
    s = F.col("speed") * 1e6
    return v.groupBy("participant", "task").agg(F.round(F.avg(s), 4).alias("speed_mean"), F.round(F.percentile(s, F.lit(0.95)), 4).alias("speed_p95"))


@query(_with("""v AS (SELECT *, CASE WHEN us > lag(us) OVER w AND sqrt((x - lag(x) OVER w) ** 2 + (seat - lag(seat) OVER w) ** 2) / ((us - lag(us) OVER w) / 1e6) <= 0.002 AND us - lag(us) OVER w <= 86400000000 THEN 0 ELSE 1 END AS fresh FROM samples WINDOW w AS (PARTITION BY participant ORDER BY us)),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY participant ORDER BY us ROWS UNBOUNDED PRECEDING) AS fixation FROM v)""")
  + """ SELECT participant, CAST(fixation AS BIGINT) AS fixation, count(*) AS n, min(us) AS start, max(us) AS "end", round(avg(x), 9) AS cx, list_extract(list(us ORDER BY us), CAST(count(*) // 2 AS INTEGER) + 1) AS middle_us FROM i GROUP BY participant, fixation HAVING count(*) >= 3""")
def fixations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("y", F.col("seat").cast("double"))
    f = win.fixations(s, ["participant"], "us", "x", "y", 0.002, DAY_US)
    return f.select("participant", "fixation", "n", "start", "end", F.round("cx", 9).alias("cx"), F.col("middle.us").alias("middle_us"))


PER_TASK_SQL = "per_task AS (SELECT session, participant, seat, task, avg(x) AS m, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM samples GROUP BY ALL)"


def per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("session", "participant", "seat", "task").agg(F.avg("x").alias("m"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))


@query(_with(PER_TASK_SQL, """b AS (SELECT participant, m AS base FROM per_task WHERE task = 0)""") + """ SELECT participant, task, round(m - base, 9) AS delta,
  round(CASE WHEN base IS NULL THEN coalesce(CASE WHEN stddev_samp(m) OVER p > 0 THEN (m - avg(m) OVER p) / stddev_samp(m) OVER p END, 0) ELSE coalesce(CASE WHEN stddev_samp(m) OVER p > 0 THEN (m - base) / stddev_samp(m) OVER p END, 0) END, 9) AS z
  FROM per_task LEFT JOIN b USING (participant) WINDOW p AS (PARTITION BY participant)""")  # fmt: skip
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's mean less the first task's, and in units of the user's spread over tasks."""
    p = per_task(spark, sf_dir).withColumn("name", F.concat(F.lit("T"), F.col("task").cast("string")))
    return p.select("participant", "task", F.round(win.baseline_delta("m", ["participant"], "name", "first_us"), 9).alias("delta"), F.round(win.baseline_z("m", ["participant"], "name", "first_us"), 9).alias("z"))


@query(_with("""p AS (SELECT participant, task, event_id, (us - min(us) OVER w) / nullif(max(us) OVER w - min(us) OVER w, 0) AS p FROM samples WINDOW w AS (PARTITION BY participant, task))""")
  + " SELECT participant, task, event_id, CASE WHEN p <= 1.0 / 3 THEN 1 WHEN p <= 2.0 / 3 THEN 2 WHEN p IS NOT NULL THEN 3 END AS segment FROM p")
def progress_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return s.select("participant", "task", "event_id", win.progress_segment("us", "us", ["participant", "task"]).alias("segment"))


@query(_with("""d AS (SELECT *, CASE WHEN lag(x) OVER w - x > 300 THEN 1 ELSE 0 END AS fall FROM samples WINDOW w AS (PARTITION BY participant ORDER BY us)),
  g AS (SELECT *, sum(fall) OVER (PARTITION BY participant ORDER BY us ROWS UNBOUNDED PRECEDING) AS segment FROM d)""")
  + " SELECT participant, event_id, CAST(segment AS BIGINT) AS segment FROM g QUALIFY segment = max(segment) OVER (PARTITION BY participant)")
def reset_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.reset_segments(samples(spark, sf_dir), ["participant"], "us", "x", 300).select("participant", "event_id", "segment")


@query(_with(PER_TASK_SQL, "q AS (SELECT session, quantile_cont(m, 0.33) AS q1, quantile_cont(m, 0.66) AS q2, min(m) AS lo, max(m) AS hi FROM per_task GROUP BY ALL)")
  + " SELECT participant, task, CASE WHEN lo = hi THEN 'Moderate' WHEN m >= q2 THEN 'High' WHEN m <= q1 THEN 'Low' ELSE 'Moderate' END AS label FROM per_task JOIN q USING (session)")
def quantile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.quantile_labels(per_task(spark, sf_dir), "m", ["session"]).select("participant", "task", "label")


@query(_with() + """ SELECT participant, event_id, round(CASE WHEN count(x) OVER p >= 3 THEN 1 + 8.0 * (row_number() OVER (PARTITION BY participant ORDER BY x, event_id) - 1) / (count(x) OVER p - 1) END, 9) AS score FROM samples WINDOW p AS (PARTITION BY participant)""")
def rank_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("participant", "event_id", F.round(win.rank_scale("x", ["participant"], "event_id"), 9).alias("score"))


@query(_with("n AS (SELECT participant, count(x) AS c, avg(x) AS m, quantile_cont(x, 0.1) AS p, stddev_pop(x) AS s FROM samples GROUP BY ALL)")
  + " SELECT event_id, round(CASE WHEN c >= 3 THEN x - m END, 9) AS less_mean, round(CASE WHEN c >= 3 THEN x - p END, 9) AS less_p10, round(CASE WHEN c >= 3 THEN CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END END, 9) AS z FROM samples JOIN n USING (participant)")
def subject_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("participant", "event_id", "x")
    for how, name in (("mean", "less_mean"), ("p10", "less_p10"), ("z", "z")):
        s = win.subject_normalised(s, "x", ["participant"], how).withColumn(name, F.round("normed", 9)).drop("normed")
    return s.select("event_id", "less_mean", "less_p10", "z")


@query(_with() + """ SELECT event_id, round(avg(CASE WHEN valid THEN x ELSE 0 END) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS centred,
  round(avg(CASE WHEN valid THEN x ELSE 0 END) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 9) AS backward, round(avg(CASE WHEN valid THEN x ELSE 0 END) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 9) AS forward FROM samples WINDOW w AS (PARTITION BY participant, task ORDER BY us)""")  # fmt: skip
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("v", F.when(F.col("valid"), F.col("x")))
    return s.select("event_id", *[F.round(win.smoothed("v", ["participant", "task"], "us", m), 9).alias(m) for m in ("centred", "backward", "forward")])


@query(_with("c AS (SELECT *, CAST((row_number() OVER (PARTITION BY participant ORDER BY us) - 1) // 4 AS BIGINT) AS chunk FROM samples)")
  + " SELECT participant, chunk, count(*) AS n, round(avg(x), 9) AS x, arg_min(event_type, us) AS event_type FROM c GROUP BY ALL")
def pooled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.pooled_chunks(samples(spark, sf_dir), ["participant"], "us", 4, ["x"], ["event_type"]).withColumn("x", F.round("x", 9))


@query(_with() + " SELECT event_id, round(coalesce((row_number() OVER (PARTITION BY participant ORDER BY task, us) - 1) / nullif(count(*) OVER (PARTITION BY participant) - 1, 0), 0), 9) AS place FROM samples")
def trial_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("event_id", F.round(win.trial_position(["participant"], ["task", "us"]), 9).alias("place"))


@query(_with() + """ SELECT event_id, round(x - coalesce(avg(CASE WHEN task = 0 THEN x END) OVER p, avg(x) OVER p), 9) AS from_baseline,
  round(x - avg(x) OVER (PARTITION BY session, task), 9) AS from_group, round((x - avg(x) OVER p) / greatest(stddev_pop(x) OVER p, 1e-6), 9) AS z FROM samples WINDOW p AS (PARTITION BY participant)""")  # fmt: skip
def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample less its user's baseline, less its group's mean, and as z of its user."""
    s = samples(spark, sf_dir)
    return s.select("event_id", F.round(win.centred("x", ["participant"], F.col("task") == 0, True), 9).alias("from_baseline"), F.round(win.centred("x", ["session", "task"]), 9).alias("from_group"), F.round(win.floored_z("x", ["participant"]), 9).alias("z"))


@query(_with("v AS (SELECT *, CASE WHEN valid THEN x END AS v, row_number() OVER (PARTITION BY participant ORDER BY us) AS i FROM samples)",
  """e AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS bi, last_value(v IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ai, first_value(v IGNORE NULLS) OVER a AS av FROM v
  WINDOW b AS (PARTITION BY participant ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY participant ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
  + " SELECT event_id, round(coalesce(v, CASE WHEN ai - bi - 1 <= 2 THEN bv + (av - bv) * (i - bi) / (ai - bi) END), 9) AS filled FROM e")
def filled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("v", F.when(F.col("valid"), F.col("x")))
    return win.filled_gaps(s, ["participant"], "us", "v", 2).select("event_id", F.round("filled", 9).alias("filled"))


@query(_with("a AS (SELECT participant, list(x ORDER BY us) AS v FROM samples GROUP BY ALL)", "p AS (SELECT participant, v, k, k * (len(v) - 1) / 9.0 AS p FROM a, unnest(range(0, 10)) u(k))")
  + " SELECT participant, CAST(k AS INTEGER) AS k, round(v[CAST(floor(p) AS INTEGER) + 1] + (v[CAST(least(floor(p) + 1, len(v) - 1) AS INTEGER) + 1] - v[CAST(floor(p) AS INTEGER) + 1]) * (p - floor(p)), 9) AS v FROM p")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's samples as ten evenly spaced points."""
    a = samples(spark, sf_dir).groupBy("participant").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "x"))), lambda r: r["x"]).alias("a"))
    return a.select("participant", F.posexplode(win.resampled(F.col("a"), 10)).alias("k", "v")).withColumn("v", F.round("v", 9))
