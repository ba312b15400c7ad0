"""Queries of the run catalogue, the window dataset and fold scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import dataset as ds
from cohorta.plans.base import DAY_US, samples, table
from cohorta.plans.states import HOUR_US, _features, _with

QUERIES, ORACLE_SQL = {}, {}

#: Names of files, one a supplier: folder and ending go by the key.
ENDINGS = ["audio|_audio.wav", "video|_acq-cam_video.mp4", "et|_acq-P1_tobii.mp4", "beh|_events.tsv", "et|_gaze.tsv", "physio|_acq-P1_physio.tsv.gz", "audio|_aud.FLAC", "audio|_notes.txt"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH e AS (SELECT s_suppkey AS k, 'sub-' || s_nationkey AS sub, 'ses-' || s_suppkey % 2 AS ses, 'T' || s_suppkey % 5 AS task, '01' AS run, ({ENDINGS!r})[CAST(s_suppkey % 8 AS INTEGER) + 1] AS ending FROM supplier),
  f AS (SELECT DISTINCT sub, ses, task, run, split_part(ending, '|', 1) AS d, sub || '/' || ses || '/' || split_part(ending, '|', 1) || '/' || sub || '_' || ses || '_task-' || task || '_run-' || run || split_part(ending, '|', 2) AS p FROM e)
  SELECT sub, ses, task, run, count(*) FILTER (WHERE d = 'audio' AND p NOT LIKE '%notes.txt') AS audio, count(*) FILTER (WHERE p LIKE '%.mp4') AS video, min(p) FILTER (WHERE d = 'beh') AS events, count(*) FILTER (WHERE d = 'et' AND p LIKE '%.tsv') AS gaze, count(*) FILTER (WHERE d = 'physio') AS physio
  FROM f GROUP BY ALL HAVING count(*) FILTER (WHERE (d = 'audio' AND p NOT LIKE '%notes.txt') OR p LIKE '%.mp4') > 0""")  # fmt: skip
def task_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of sessions by their files."""
    k = F.col("s_suppkey")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    s = table(spark, sf_dir, "supplier").select(text("sub-", F.col("s_nationkey")).alias("u"), text("ses-", k % 2).alias("v"), text("T", k % 5).alias("t"), F.split(F.get(F.array(*map(F.lit, ENDINGS)), (k % 8).cast("int")), r"\|").alias("e"))
    path = s.select(text(F.col("u"), "/", F.col("v"), "/", F.col("e")[0], "/", F.col("u"), "_", F.col("v"), "_task-", F.col("t"), "_run-01", F.col("e")[1]).alias("path"))
    r = ds.task_runs(path, "path")
    return r.select("sub", "ses", "task", "run", "events", *[F.size(c).cast("long").alias(c) for c in ("audio", "video", "gaze", "physio")])


@query(_with("r AS (SELECT event_id, participant, session, task, us, CAST(x AS DOUBLE) AS rating FROM samples WHERE event_type = 'purchase')",
  f"h AS (SELECT r.event_id, s.us, s.x, s.us - r.us AS since FROM r JOIN samples s ON s.participant = r.participant AND s.us BETWEEN r.us - {3 * DAY_US} AND r.us WHERE s.event_type = 'view')",
  "f AS (SELECT event_id, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS min, max(x) AS max, regr_slope(x, since) AS slope, list(x ORDER BY us, x) AS l FROM h GROUP BY ALL HAVING count(*) >= 3)",
  f"p AS (SELECT r.event_id, sum(least(r.us, s.us + {HOUR_US}) - greatest(r.us - {3 * DAY_US}, s.us)) AS speech FROM r JOIN samples s ON s.participant = r.participant AND r.us - {3 * DAY_US} < s.us + {HOUR_US} AND r.us > s.us WHERE s.event_type = 'click' GROUP BY ALL)",
  "t AS (SELECT participant, avg(x) AS trait FROM samples WHERE event_type = 'signup' GROUP BY ALL)")
  + f""" SELECT event_id, session, task, rating, n, round(mean, 6) AS mean, round(sd, 6) AS sd, min, max, round(slope * {DAY_US}, 5) AS slope, CAST(coalesce(speech, 0) AS BIGINT) AS speech, round(trait, 6) AS trait,
  array_to_string(list_transform(range(5), lambda k: CAST(round((l[1 + CAST(floor(k * (n - 1) / 4.0) AS BIGINT)] + (l[least(n, 2 + CAST(floor(k * (n - 1) / 4.0) AS BIGINT))] - l[1 + CAST(floor(k * (n - 1) / 4.0) AS BIGINT)]) * (k * (n - 1) / 4.0 - floor(k * (n - 1) / 4.0))) * 1000) AS BIGINT)), ',') AS sequence
  FROM r JOIN f USING (event_id) LEFT JOIN p USING (event_id) LEFT JOIN t USING (participant)""")  # fmt: skip
def window_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every purchase with the views, clicks and traits of the three days up to it."""
    s = samples(spark, sf_dir)
    of = lambda kind: s.where(F.col("event_type") == kind)
    reports = of("purchase").select("event_id", "participant", "session", "task", "us", F.col("x").alias("rating"))
    clicks = of("click").select("participant", "us", (F.col("us") + HOUR_US).alias("until"))
    traits = of("signup").groupBy("participant").agg(F.avg("x").alias("trait"))
    d = ds.window_dataset(reports, of("view"), clicks, traits, ["participant"], "event_id", "us", "x", ("us", "until"), 3 * DAY_US, 5, 3)
    line = F.array_join(F.transform("sequence", lambda v: F.round(v * 1000).cast("long").cast("string")), ",")
    return d.select("event_id", "session", "task", "rating", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd")], "min", "max", F.round(F.col("slope") * DAY_US, 5).alias("slope"), F.col("speech").cast("long").alias("speech"), F.round("trait", 6).alias("trait"), line.alias("sequence"))


@query()
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the level of a user's task is told from its spread and peak, each task left out once."""
    f = _features(spark, sf_dir).withColumn("label", F.when(F.col("eda") < 20, 0).when(F.col("eda") < 30, 1).otherwise(2))
    return ds.fold_scores(f, "task", ["pupil_sd", "rate", "rmssd"], "label")


def _pool_sql(kind: str) -> str:
    return f"""{kind}_f AS (SELECT participant, w.win, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS low, max(x) AS high, regr_slope(x, us - a) AS slope FROM w JOIN (SELECT participant AS p, us, x FROM samples WHERE event_type = '{kind}') s ON s.p = w.participant AND us >= a AND us < z GROUP BY participant, w.win HAVING count(*) >= 3)"""


@query(_with(f"b AS (SELECT participant, min(us) AS first, max(us) AS last FROM samples GROUP BY ALL)", f"w AS (SELECT participant, CAST(i AS BIGINT) AS win, first + i * {10 * DAY_US} AS a, first + i * {10 * DAY_US} + {20 * DAY_US} AS z FROM b, unnest(range(0, (last - first) // {10 * DAY_US} + 1)) u(i))", _pool_sql("view"), _pool_sql("click"))
  + f""" SELECT participant, win, a, v.n AS view_n, round(v.mean, 7) AS view_mean, round(v.sd, 7) AS view_sd, round(v.slope * {DAY_US}, 5) AS view_slope, c.n AS click_n, round(c.low, 7) AS click_min, round(c.high, 7) AS click_max FROM w JOIN view_f v USING (participant, win) JOIN click_f c USING (participant, win)""")
def window_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-day windows of each user, begun every ten days, with three views and three clicks or more."""
    s = samples(spark, sf_dir)
    step = F.lit(10 * DAY_US)
    ends = s.groupBy("participant").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    w = ends.select("participant", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / step))).alias("win"))
    w = w.select("participant", "win", (F.col("first") + F.col("win") * step).alias("a")).withColumn("z", F.col("a") + 2 * step)
    kinds = {k: (s.where(F.col("event_type") == k), "x") for k in ("view", "click")}
    p = ds.window_pool(w, kinds, ["participant"], "win", "a", "z", "us", 5, 3)
    return p.select("participant", "win", "a", "view_n", F.round("view_mean", 7).alias("view_mean"), F.round("view_sd", 7).alias("view_sd"), F.round(F.col("view_slope") * DAY_US, 5).alias("view_slope"), "click_n", F.round("click_min", 7).alias("click_min"), F.round("click_max", 7).alias("click_max"))
