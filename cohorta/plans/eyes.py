"""Queries of the eye-tracking row and of small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import eyes
from cohorta.operators.states import left_out_posterior
from cohorta.plans.base import SAMPLES_SQL, samples, table

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


_ROUNDED = ("duration_s", "gaze_valid", "gaze_out", "dispersion", "speed_mean", "pupil_mean", "pupil_missing", "pupil_range", "pupil_speed", "left_sd", "right_missing", "eyes_apart", "blinks_min", "blink_s")


@query(_with("""e AS (SELECT participant, us // 3600000 AS us, event_id, x / 200 AS x, event_id % 120 / 100 AS y, CASE WHEN event_type <> 'view' THEN 1 + x / 25 END AS l, CASE WHEN event_type <> 'click' THEN 1.1 + x / 26 END AS r, coalesce(valid, false) AS ok FROM samples)""",
  "s AS (SELECT *, coalesce((l + r) / 2, l, r) AS p, row_number() OVER w AS i, (us - lag(us) OVER w) / 1e6 AS dt, ok AND lag(ok) OVER w AS both_, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM e WINDOW w AS (PARTITION BY participant ORDER BY us, event_id))",
  "v AS (SELECT *, CASE WHEN both_ AND dt > 0 THEN d / dt END AS v, CASE WHEN dt > 0 THEN abs(p - lag(p) OVER (PARTITION BY participant ORDER BY i)) / dt END AS pv, avg(CASE WHEN ok THEN x END) OVER (PARTITION BY participant) AS cx, avg(CASE WHEN ok THEN y END) OVER (PARTITION BY participant) AS cy FROM s)",
  "b AS (SELECT participant, count(*) AS blinks, avg(s) AS blink_s FROM (SELECT participant, run, (max(us) - min(us)) / 1e6 AS s FROM (SELECT *, i - row_number() OVER (PARTITION BY participant, ok ORDER BY i) AS run FROM s) WHERE NOT ok GROUP BY ALL) WHERE s BETWEEN 0.05 AND 0.4 GROUP BY ALL)",
  """a AS (SELECT participant, count(*) AS n, CASE WHEN count(*) > 1 THEN (max(us) - min(us)) / 1e6 END AS duration_s, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS gaze_valid, avg(CASE WHEN x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 THEN 0.0 ELSE 1 END) FILTER (ok) AS gaze_out,
  CASE WHEN count(*) FILTER (ok) > 1 THEN avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) FILTER (ok) END AS dispersion, avg(v) AS speed_mean, avg(p) AS pupil_mean, avg(CASE WHEN p IS NULL THEN 1.0 ELSE 0 END) AS pupil_missing, max(p) - min(p) AS pupil_range, avg(pv) AS pupil_speed, stddev_pop(l) AS left_sd,
  avg(CASE WHEN l IS NULL THEN 1.0 ELSE 0 END) AS left_missing, avg(CASE WHEN r IS NULL THEN 1.0 ELSE 0 END) AS right_missing, avg(abs(l - r)) AS eyes_apart, CASE WHEN count(*) >= 5 THEN 1 / quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) END AS hz FROM v GROUP BY ALL)""",
  "f AS (SELECT *, coalesce(blinks, 0) AS bl, CASE WHEN duration_s > 0 THEN coalesce(blinks, 0) / (duration_s / 60) END AS blinks_min FROM a LEFT JOIN b USING (participant))")
  + """ SELECT participant, n, bl AS blinks, round(duration_s, 7) AS duration_s, round(gaze_valid, 7) AS gaze_valid, round(gaze_out, 7) AS gaze_out, round(dispersion, 7) AS dispersion, round(speed_mean, 7) AS speed_mean, round(pupil_mean, 7) AS pupil_mean, round(pupil_missing, 7) AS pupil_missing, round(pupil_range, 7) AS pupil_range,
  round(pupil_speed, 7) AS pupil_speed, round(left_sd, 7) AS left_sd, round(right_missing, 7) AS right_missing, round(eyes_apart, 7) AS eyes_apart, round(blinks_min, 7) AS blinks_min, round(blink_s, 7) AS blink_s,
  coalesce(nullif(concat_ws(';', CASE WHEN duration_s < 30 THEN 'short_duration' END, CASE WHEN hz IS NULL THEN 'sample_rate_unavailable' END, CASE WHEN NOT hz BETWEEN 40 AND 60 THEN 'sample_rate_unusual' END, CASE WHEN gaze_valid < 0.7 THEN 'gaze_low_validity' END, CASE WHEN pupil_missing > 1 - 0.7::DOUBLE THEN 'pupil_low_coverage' END,
  CASE WHEN left_missing > 1 - 0.7::DOUBLE THEN 'pupil_left_low_coverage' END, CASE WHEN right_missing > 1 - 0.7::DOUBLE THEN 'pupil_right_low_coverage' END, CASE WHEN NOT pupil_mean BETWEEN 1.5 AND 9 THEN 'pupil_implausible' END, CASE WHEN eyes_apart > 1.5 THEN 'pupil_asymmetry_large' END,
  CASE WHEN NOT blinks_min BETWEEN 3 AND 45 THEN 'blink_rate_unusual' END, CASE WHEN gaze_out > 0.1 THEN 'gaze_out_of_bounds' END, CASE WHEN pupil_speed > 1 THEN 'pupil_velocity_spike' END), ''), 'ok') AS qc FROM f""")  # fmt: skip
def eye_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as eyes, an hour and a bit as a millisecond."""
    s = samples(spark, sf_dir).select("participant", "event_id", F.floor(F.col("us") / 3_600_000).alias("us"), (F.col("x") / 200).alias("x"), (F.col("event_id") % 120 / 100).alias("y"), F.when(F.col("event_type") != "view", 1 + F.col("x") / 25).alias("l"), F.when(F.col("event_type") != "click", 1.1 + F.col("x") / 26).alias("r"), "valid")
    e = eyes.eye_row(s, ["participant"], "us", "x", "y", "l", "r", "valid", ["us", "event_id"])
    return e.select("participant", "n", "blinks", *[F.round(c, 7).alias(c) for c in _ROUNDED], "qc")


@query(_with("d AS (SELECT *, x - lag(x) OVER (PARTITION BY participant ORDER BY us, event_id) AS d FROM samples)")
  + " SELECT participant, count(*) AS points, coalesce(min(d) >= 0, true) AS monotonic, round(coalesce(max(d), 0), 9) AS largest_gap, arg_max(coalesce(CASE WHEN valid THEN event_id % 7 END, 0), (us, event_id)) AS dropped, arg_max(event_id % 5, (us, event_id)) AS doubled FROM d GROUP BY participant")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("a", F.when(F.col("valid"), F.col("event_id") % 7)).withColumn("b", F.col("event_id") % 5)
    return eyes.progress_counts(s, ["participant"], ["us", "event_id"], "x", "a", "b").withColumn("largest_gap", F.round("largest_gap", 9))


@query("""WITH l AS (SELECT o_orderpriority AS dim, 1 + o_custkey % 9 AS y FROM orders), c AS (SELECT dim, k AS cut, count(*) FILTER (y > k) AS positive, count(*) AS n FROM l, unnest(range(1, 9)) u(k) GROUP BY dim, k)
SELECT dim, CAST(cut AS INTEGER) AS cut, positive, round(least(greatest((n - positive) / greatest(positive, 1), 0.25), 4), 9) AS weight FROM c""")
def cut_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dim"), (1 + F.col("o_custkey") % 9).alias("y"))
    return eyes.cut_weights(o, ["dim"], "y").withColumn("weight", F.round("weight", 9))


@query()
def left_out_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as ratings of 1 to 9, each scored from the user's others."""
    s = samples(spark, sf_dir).where("event_type = 'signup'").select("participant", (F.col("us") / 8.64e10).alias("t"), (1 + F.col("x") % 9).alias("y"))
    return eyes.left_out_scores(left_out_posterior(s, ["participant"], "t", "y", 5.0, 0.5, 1.5, 0.8), 3.0, 6.0)


@query("""WITH s AS (SELECT conv_id, turn, role, CASE WHEN length(text) % 4 = 0 THEN 'uncertain' WHEN length(text) % 4 = 1 THEN 'sure' END AS c, coalesce(CAST(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) <> role AS INTEGER), 0) AS t FROM conversations)
SELECT conv_id, role, count(*) AS segments, CAST(sum(t) AS BIGINT) AS turns, round(avg(CASE WHEN c = 'uncertain' THEN 1.0 ELSE 0 END), 4) AS uncertain_share FROM s GROUP BY conv_id, role""")
def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("c", F.when(F.length("text") % 4 == 0, "uncertain").when(F.length("text") % 4 == 1, "sure"))
    return eyes.speaker_turns(c, ["conv_id"], ["turn", "text"], "role", "c")
