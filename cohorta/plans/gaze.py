"""Queries of gaze, pupil, gap filling and warped sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohorta.operators import gaze, splines
from cohorta.plans.base import DAY_US, SAMPLES_SQL, samples, table

QUERIES, ORACLE_SQL = {}, {}
WIDTH = 30 * DAY_US


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join([SAMPLES_SQL, *ctes])


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("month", F.floor(F.col("us") / WIDTH))
    return s.select("participant", "month", "us", "event_id", (F.col("x") / 200).alias("gx"), (F.col("event_id") % 101 / 100).alias("gy"), "valid", "x")


_ENTROPY = lambda name, cells: f"{name} AS (SELECT participant, month, -sum(p * ln(p)) AS {name} FROM (SELECT participant, month, n / sum(n) OVER (PARTITION BY participant, month) AS p FROM (SELECT participant, month, count(*) AS n FROM q WHERE {' AND '.join(c + ' IS NOT NULL' for c in cells)} GROUP BY participant, month, {', '.join(cells)})) GROUP BY ALL)"


@query(_with(f"l AS (SELECT participant, us // {WIDTH} AS month, us, event_id, x / 200 AS gx, event_id % 101 / 100 AS gy, valid FROM samples)", "o AS (SELECT participant, month, count(*) AS al, avg(CASE WHEN valid AND gx IS NOT NULL THEN 1.0 ELSE 0 END) AS validity FROM l GROUP BY ALL)",
  "v AS (SELECT *, row_number() OVER w AS i, sqrt((gx - lag(gx) OVER w) ** 2 + (gy - lag(gy) OVER w) ** 2) AS d, CAST(gx > 0.5 AS INTEGER) * 2 + CAST(gy > 0.5 AS INTEGER) AS quad FROM l WHERE valid AND gx IS NOT NULL WINDOW w AS (PARTITION BY participant, month ORDER BY us, event_id))",
  "q AS (SELECT *, coalesce(d * 2 < 0.5, true) AS fix, CAST(quad <> lag(quad) OVER (PARTITION BY participant, month ORDER BY i) AS INTEGER) AS turn, CASE WHEN gx BETWEEN 0 AND 1 THEN least(floor(gx * 10), 9) END AS bx, CASE WHEN gy BETWEEN 0 AND 1 THEN least(floor(gy * 10), 9) END AS by_ FROM v)",
  "r AS (SELECT *, i - row_number() OVER (PARTITION BY participant, month, fix ORDER BY i) AS run FROM q)",
  "f AS (SELECT participant, month, count(*) AS fixations, avg(m) * 500 AS ms, avg(spread) AS spread FROM (SELECT participant, month, run, count(*) AS m, max(gx) - min(gx) + max(gy) - min(gy) AS spread FROM r WHERE fix GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL)",
  _ENTROPY("entropy_x", ["bx"]), _ENTROPY("entropy_2d", ["bx", "by_"]),
  """a AS (SELECT participant, month, count(*) AS n, avg(gx) AS x_mean, stddev_pop(gy) AS y_sd, count(*) FILTER (d * 2 > 0.5) AS saccades, coalesce(avg(d) FILTER (d * 2 > 0.5), 0) AS saccade_size, sum(d) AS path, coalesce(sum(turn), 0) AS turns, avg(CASE WHEN quad = 3 THEN 1.0 ELSE 0 END) AS dwell_4 FROM q GROUP BY ALL)""")
  + """ SELECT o.participant, o.month, round(validity, 8) AS validity, CASE WHEN n >= 5 THEN round(x_mean, 8) END AS x_mean, CASE WHEN n >= 5 THEN round(y_sd, 8) END AS y_sd, CASE WHEN n >= 5 THEN saccades END AS saccades, CASE WHEN n >= 5 THEN round(saccade_size, 8) END AS saccade_size,
  CASE WHEN n >= 5 THEN round(path, 8) END AS path, CASE WHEN n >= 5 THEN round(dwell_4, 8) END AS dwell_4, CASE WHEN n >= 5 THEN coalesce(fixations, 0) END AS fixations, CASE WHEN n >= 5 THEN round(ms, 6) END AS fixation_ms, CASE WHEN n >= 5 THEN round(spread, 8) END AS fixation_spread,
  CASE WHEN n >= 5 THEN coalesce(round(entropy_x, 8), 0) END AS entropy_x, CASE WHEN n >= 5 THEN coalesce(round(entropy_2d, 8), 0) END AS entropy_2d, CASE WHEN n >= 5 THEN round(turns / greatest(al / 2, 0.1), 8) END AS transitions_s
  FROM o LEFT JOIN a USING (participant, month) LEFT JOIN f USING (participant, month) LEFT JOIN entropy_x USING (participant, month) LEFT JOIN entropy_2d USING (participant, month)""")  # fmt: skip
def gaze_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' months as gaze at 2 Hz."""
    g = gaze.gaze_features(_looks(spark, sf_dir), ["participant", "month"], ["us", "event_id"], "gx", "gy", "valid", 2.0, threshold=0.5)
    shown = ("validity", "x_mean", "y_sd", "saccade_size", "path", "dwell_4", "fixation_spread", "entropy_x", "entropy_2d", "transitions_s")
    return g.select("participant", "month", "saccades", "fixations", F.round("fixation_ms", 6).alias("fixation_ms"), *[F.round(c, 8).alias(c) for c in shown])


@query()
def gaze_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area each user looks over, by partial hulls."""
    return gaze.hull_areas(_looks(spark, sf_dir), ["participant"], "gx", "gy")


@query(_with(f"l AS (SELECT participant, us // {WIDTH} AS month, us, event_id, 1 + x / 60 AS l, 1.2 + x / 61 AS r, valid AND 1 + x / 60 < 10 AS ok, row_number() OVER (PARTITION BY participant, us // {WIDTH} ORDER BY us, event_id) AS i FROM samples WHERE x IS NOT NULL)",
  "k AS (SELECT participant, month, count(*) AS al, bool_and(r > 0.5 AND r < 10) FILTER (ok) AS both_ FROM l GROUP BY ALL)", "v AS (SELECT l.*, CASE WHEN both_ THEN (l + r) / 2 ELSE l END AS p, row_number() OVER (PARTITION BY participant, month ORDER BY i) AS t FROM l JOIN k USING (participant, month) WHERE ok)",
  "d AS (SELECT *, p - lag(p) OVER (PARTITION BY participant, month ORDER BY i) AS d FROM v)",
  "a AS (SELECT participant, month, count(*) AS n, avg(l) AS left_mean, avg(r) FILTER (r > 0.5 AND r < 10) AS right_mean, quantile_cont(p, 0.5) AS pupil_median, sqrt(avg(d * d)) AS rmssd, regr_slope(p, t) AS slope, avg(abs(d)) * 2 AS change_mean, kurtosis_pop(p) AS kurtosis FROM d GROUP BY ALL)",
  "g AS (SELECT participant, month, min(i) AS a, max(i) AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY participant, month, ok ORDER BY i) AS run FROM l) WHERE NOT ok GROUP BY participant, month, run)",
  "b AS (SELECT participant, month, count(*) AS blinks, avg(z - a + 1) * 500 AS ms, avg(since) / 2 AS gap FROM (SELECT *, a - lag(z) OVER (PARTITION BY participant, month ORDER BY a) - 1 AS since FROM g) GROUP BY ALL)")
  + """ SELECT k.participant, k.month, CASE WHEN n >= 10 THEN round(left_mean, 8) END AS left_mean, CASE WHEN n >= 10 THEN round(right_mean, 8) END AS right_mean, CASE WHEN n >= 10 THEN round(pupil_median, 8) END AS pupil_median, CASE WHEN n >= 10 THEN round(rmssd, 8) END AS rmssd,
  CASE WHEN n >= 10 THEN round(slope, 7) END AS slope, CASE WHEN n >= 10 THEN round(change_mean, 8) END AS change_mean, CASE WHEN n >= 10 THEN round(kurtosis, 6) END AS kurtosis, CASE WHEN n >= 10 THEN round(coalesce(blinks, 0) / greatest(al / 2, 0.1), 8) END AS blinks_s,
  CASE WHEN n >= 10 THEN round(coalesce(ms, 0), 6) END AS blink_ms, CASE WHEN n >= 10 THEN round(gap, 8) END AS between_blinks_s FROM k LEFT JOIN a USING (participant, month) LEFT JOIN b USING (participant, month)""")  # fmt: skip
def pupil_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' months as pupils at 2 Hz, without the fast share, which SQL has not."""
    s = _looks(spark, sf_dir).where("x is not null").withColumn("l", 1 + F.col("x") / 60).withColumn("r", 1.2 + F.col("x") / 61)
    p = gaze.pupil_features(s, ["participant", "month"], ["us", "event_id"], "l", "r", "valid", 2.0)
    eight = ("left_mean", "right_mean", "pupil_median", "rmssd", "change_mean", "blinks_s", "between_blinks_s")
    return p.select("participant", "month", *[F.round(c, 8).alias(c) for c in eight], F.round("slope", 7).alias("slope"), F.round("kurtosis", 6).alias("kurtosis"), F.round("blink_ms", 6).alias("blink_ms"))


@query()
def pupil_fast_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _looks(spark, sf_dir).withColumn("l", 1 + F.col("x") / 60)
    return gaze.pupil_features(s, ["participant"], ["us", "event_id"], "l", "l", "valid", 2.0).select("participant", "fast_share")


@query()
def cubic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' samples with the invalid ones filled by a spline; tests hold it against a dense solver."""
    s = samples(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("participant").orderBy("us", "event_id")))
    s = s.select("participant", "event_id", "i", F.when(F.col("valid"), F.col("x")).alias("v"))
    return splines.filled_cubic(s, ["participant"], "i", "v").select("participant", "event_id", "filled")


@query()
def warped_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bent copies and one pressed copy of every vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    one, two = splines.warped(v, "vec_id", "embedding", 2, "time"), splines.warped(v, "vec_id", "embedding", 1, "window")
    return one.withColumn("how", F.lit("time")).unionByName(two.withColumn("how", F.lit("window")))
