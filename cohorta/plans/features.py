"""Queries of the feature operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import features as feat
from cohorta.operators import signals
from cohorta.plans.base import DAY_US, SAMPLES_SQL, day_sums, samples, table

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


@query(_with("v AS (SELECT *, CASE WHEN valid AND x <= 300 THEN x END AS v FROM samples)") + """ SELECT participant, task, count(v) AS n, round(100.0 * count(v) / count(*), 9) AS coverage, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.5), 9) AS median,
  round(stddev_pop(v), 9) AS sd, min(v) AS "min", round(quantile_cont(v, 0.95), 9) AS p95, max(v) AS "max" FROM v GROUP BY ALL""")
def basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("v", F.when(F.col("valid") & (F.col("x") <= 300), F.col("x")))
    a = s.groupBy("participant", "task").agg(*feat.basic("v"))
    return a.select("participant", "task", "n", "min", "max", *[F.round(c, 9).alias(c) for c in ("coverage", "mean", "median", "sd", "p95")])


@query(_with("c AS (SELECT participant, task, (us - min(us) OVER w) / 8.64e10 AS d, x - avg(x) OVER w AS y, x FROM samples WINDOW w AS (PARTITION BY participant, task))")
  + """ SELECT participant, task, round(CASE WHEN count(*) >= 2 AND sum(d * d) > 0 THEN sum(d * y) / sum(d * d) END, 6) AS slope, round(CASE WHEN count(*) >= 2 THEN regr_slope(x, d) END, 6) AS ols FROM c GROUP BY ALL""")
def slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope a day, as published and by least squares."""
    s = samples(spark, sf_dir).withColumn("first", F.expr("min(us) OVER (PARTITION BY participant, task)")).withColumn("d", (F.col("us") - F.col("first")) / 8.64e10)
    keys = ["participant", "task"]
    both = feat.slope(s, keys, "d", "x").join(feat.slope(s, keys, "d", "x", True).withColumnRenamed("slope", "ols"), keys)
    return both.select(*keys, F.round("slope", 6).alias("slope"), F.round("ols", 6).alias("ols"))


@query(_with("d AS (SELECT *, (us - lag(us) OVER (PARTITION BY participant ORDER BY us)) / 1e6 AS d FROM samples)")
  + " SELECT participant, round(CASE WHEN count(*) >= 5 THEN 3600 / quantile_cont(CASE WHEN d > 0 THEN d END, 0.5) END, 9) AS per_hour FROM d GROUP BY ALL")
def sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.sample_rate(samples(spark, sf_dir), ["participant"], "us").select("participant", F.round(F.col("rate_hz") * 3600, 9).alias("per_hour"))


@query(_with("m AS (SELECT *, sqrt(x * x + (event_id % 100) * (event_id % 100)) AS m FROM samples)", "d AS (SELECT participant, quantile_cont(m, 0.5) AS mid FROM m GROUP BY ALL)")
  + " SELECT participant, round(avg(m), 9) AS mag_mean, round(quantile_cont(m, 0.95), 9) AS mag_p95, round(max(m), 9) AS mag_max, round(avg(abs(m - mid) * 0.5), 9) AS jerk_mean, round(avg(CASE WHEN abs(m - mid) > 20 THEN 1.0 ELSE 0 END), 9) AS moving FROM m JOIN d USING (participant) GROUP BY participant")
def motion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("y", (F.col("event_id") % 100).cast("double"))
    m = feat.motion(s, ["participant"], ["x", "y"], 0.5, 20)
    return m.select("participant", *[F.round(c, 9).alias(c) for c in m.columns[1:]])


@query(_with("v AS (SELECT *, (event_id % 100) / 100.0 AS y, x / 100 AS gx, valid AND lag(valid) OVER w AS ok, (us - lag(us) OVER w) / 1e6 AS dt FROM samples WINDOW w AS (PARTITION BY participant ORDER BY us))",
  "d AS (SELECT *, sqrt((gx - lag(gx) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM v WINDOW w AS (PARTITION BY participant ORDER BY us))",
  """a AS (SELECT participant, count(*) AS n, avg(CASE WHEN valid THEN 1.0 ELSE 0 END) AS valid_share, avg(gx) FILTER (WHERE valid) AS cx, sqrt(var_pop(gx) FILTER (WHERE valid) + var_pop(y) FILTER (WHERE valid)) AS dispersion,
  avg(CASE WHEN gx BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 THEN 0.0 ELSE 1 END) FILTER (WHERE valid) AS out_share, avg(CASE WHEN ok AND dt > 0 THEN 1e6 * d / dt END) AS speed FROM d GROUP BY participant)""")
  + """ SELECT participant, n, round(valid_share, 9) AS valid_share, round(cx, 9) AS cx, round(dispersion, 9) AS dispersion, round(out_share, 9) AS out_share, round(speed, 6) AS speed,
  coalesce(nullif(concat_ws(';', CASE WHEN valid_share < 0.8 THEN 'few_valid' END, CASE WHEN coalesce(out_share, 0) > 0.2 THEN 'out_of_bounds' END, CASE WHEN speed IS NULL THEN 'no_motion' END), ''), 'ok') AS qc FROM a""")  # fmt: skip
def eye_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("y", F.col("event_id") % 100 / 100).withColumn("gx", F.col("x") / 100)
    e = feat.eye_tracking(s, ["participant"], "us", "gx", "y", "valid", least_valid=0.8)
    return e.select("participant", "n", *[F.round(c, 9).alias(c) for c in ("valid_share", "cx", "dispersion", "out_share")], F.round(F.col("speed_mean") * 1e6, 6).alias("speed"), "qc")


@query(_with("p AS (SELECT *, CASE WHEN event_type <> 'view' THEN x END AS l, CASE WHEN event_type <> 'click' THEN x + 1 END AS r FROM samples)", "q AS (SELECT *, coalesce((l + r) / 2, l, r) AS p FROM p)")
  + " SELECT participant, round(avg(p), 9) AS pupil_mean, round(stddev_pop(p), 9) AS pupil_sd, round(avg(CASE WHEN p IS NULL THEN 1.0 ELSE 0 END), 9) AS missing, round(avg(CASE WHEN valid THEN 1.0 ELSE 0 END), 9) AS validity, round(avg(l - r), 9) AS asymmetry FROM q GROUP BY ALL")
def pupil_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("l", F.when(F.col("event_type") != "view", F.col("x"))).withColumn("r", F.when(F.col("event_type") != "click", F.col("x") + 1))
    p = feat.pupil(s, ["participant"], "t", "l", "r", "valid")
    return p.select("participant", *[F.round(c, 9).alias(c) for c in ("pupil_mean", "pupil_sd", "missing", "validity", "asymmetry")])


@query(_with("b AS (SELECT participant, least(floor(x / 30), 9) AS b, count(*) AS n FROM samples WHERE x BETWEEN 0 AND 300 GROUP BY ALL)", "p AS (SELECT *, n / sum(n) OVER (PARTITION BY participant) AS p FROM b)")
  + " SELECT participant, round(-sum(p * ln(p)), 9) AS entropy FROM p GROUP BY ALL")
def gaze_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.entropy(samples(spark, sf_dir), ["participant"], "x", 10, 0, 300).withColumn("entropy", F.round("entropy", 9))


@query(_with("d AS (SELECT participant, x, x - lag(x) OVER (PARTITION BY participant ORDER BY us) AS d FROM samples)")
  + " SELECT participant, round(sqrt(avg(d * d)), 9) AS rmssd, round(max(x) - min(x), 9) AS \"range\", round(avg(d), 9) AS d_mean, round(stddev_pop(d), 9) AS d_sd, round(kurtosis_pop(x), 6) AS kurtosis FROM d GROUP BY ALL")
def pupil_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = feat.pupil_shape(samples(spark, sf_dir), ["participant"], "us", "x")
    return p.select("participant", *[F.round(c, 9).alias(c) for c in ("rmssd", "range", "d_mean", "d_sd")], F.round("kurtosis", 6).alias("kurtosis"))


@query(_with("e AS (SELECT session, seat, sqrt(x * x / (1 + event_id % 5)) AS r FROM samples)", "a AS (SELECT session, seat, avg(r) AS m, quantile_cont(r, 0.5) AS md, stddev_pop(r) AS sd, max(r) AS mx FROM e GROUP BY ALL)")
  + " SELECT session, seat, round(m, 9) AS rms_mean, round(md, 9) AS rms_median, round(sd, 9) AS rms_sd, round(mx, 9) AS rms_max, round(greatest(20 * log10(greatest(m, 1e-10)), -80), 9) AS db_mean FROM a")
def audio_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("sq", F.col("x") ** 2).withColumn("n", 1 + F.col("event_id") % 5)
    a = feat.levels(s, ["session", "seat"], "sq", "n")
    return a.select("session", "seat", *[F.round(c, 9).alias(c) for c in a.columns[2:]])


@query(_with(f"f AS (SELECT session, seat, us // {DAY_US} AS frame, avg(x) AS rms FROM samples GROUP BY ALL)",
  "o AS (SELECT a.*, coalesce((SELECT max(b.rms) FROM f b WHERE b.session = a.session AND b.frame = a.frame AND b.seat <> a.seat), 0) AS other FROM f a)") + " SELECT session, seat, frame, rms > 20 AND rms >= 1.5 * other AS speaking FROM o")
def dominant_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = day_sums(spark, sf_dir).select("session", "seat", "frame", F.try_divide("total", "n").alias("rms"))
    return feat.dominant(f, ["session"], "frame", "seat", "rms", 20, 1.5).select("session", "seat", "frame", "speaking")


@query("""WITH t AS (SELECT conv_id, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role THEN 1 ELSE 0 END AS t FROM conversations)
SELECT conv_id, role, count(*) AS segments, CAST(sum(t) AS BIGINT) AS turns FROM t GROUP BY ALL""")
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = feat.turns(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role")
    return t.select("conv_id", "role", "segments", F.col("turns").cast("long").alias("turns"))


@query(_with("c AS (SELECT participant, seat, task, avg(x) AS q FROM samples GROUP BY ALL)") + " SELECT participant, CAST(arg_max(task, (q, -task)) AS INTEGER) AS channel, round(max(q), 9) AS quality FROM c GROUP BY participant")
def best_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = samples(spark, sf_dir).groupBy("participant", "task").agg(F.avg("x").alias("q"))
    return feat.best_channel(c, ["participant"], "task", "q").withColumn("quality", F.round("quality", 9))


@query()
def skin_conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.by_group(samples(spark, sf_dir).select("participant", "us", "x"), ["participant"], "us", lambda r: signals.eda(r, "x", 4.0), signals.EDA_SCHEMA)


@query()
def pulse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("session", "us", "x")
    return signals.by_group(s, ["session"], "us", lambda r: signals.spectral_rate(r, "x", 25.0) | signals.pulse(r, "x", 25.0), f"per_minute double, {signals.PULSE_SCHEMA}")


@query()
def scan_path_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("participant", "us", "x", (F.col("event_id") % 100).cast("double").alias("y"))
    return signals.by_group(s, ["participant"], "us", lambda r: signals.hull_area(r, "x", "y"), "area double")


@query()
def rating_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as ratings: their smooth course at the time of every view of the user."""
    s = samples(spark, sf_dir).withColumn("t", F.col("us") / DAY_US)
    o = s.where("event_type = 'signup'").select("participant", "t", F.col("x").alias("y"), F.lit(10.0).alias("noise"))
    return signals.process_posterior(s.where("event_type = 'view'").select("participant", "t"), o, ["participant"], 50.0, 0.5, 30.0)
