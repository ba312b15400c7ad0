"""Queries of label transfer, ridge predictions, physiological events, track repair and start shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohorta.operators import models as mod
from cohorta.plans.base import samples, table
from cohorta.plans.states import FEATURES_SQL, HOUR_US, _features, _with

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH l AS (SELECT p_brand, min(p_type) AS kind, CAST(avg(p_size) AS DOUBLE) AS size, avg(CAST(p_retailprice AS DOUBLE)) AS price FROM part GROUP BY ALL),
  s AS (SELECT avg(size) AS m, stddev_pop(size) AS d, avg(price) AS n, stddev_pop(price) AS e FROM l),
  near AS (SELECT p_partkey, l.kind, sqrt(((p_size - l.size) / d) ** 2 + ((CAST(p_retailprice AS DOUBLE) - l.price) / e) ** 2) AS dist, row_number() OVER (PARTITION BY p_partkey ORDER BY dist, l.p_brand) AS r FROM part, l, s),
  v AS (SELECT p_partkey, kind, sum(1 / dist) AS w FROM near WHERE r <= 7 GROUP BY ALL)
  SELECT p_partkey, arg_max(kind, w) AS label, round(max(w) / sum(w), 6) AS confidence FROM v GROUP BY ALL""")  # fmt: skip
def knn_label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of the brands whose mean size and price are nearest to a part's."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    brands = p.groupBy("p_brand").agg(F.min("p_type").alias("kind"), F.avg("size").alias("size"), F.avg("price").alias("price"))
    return mod.knn_labels(p.select("p_partkey", "size", "price"), brands, "p_brand", ["size", "price"], "kind").select("p_partkey", "label", F.round("confidence", 6).alias("confidence"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return s.withColumn("i", F.row_number().over(Window.partitionBy("participant").orderBy("us", "event_id")) - 1)


INDEXED_SQL = "ix AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY us, event_id) - 1 AS i FROM samples)"


@query(_with(INDEXED_SQL, "f AS (SELECT participant, i, coalesce(last_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER (PARTITION BY participant ORDER BY i), 0) AS v FROM ix)",
  "g AS (SELECT *, stddev_pop(v) OVER (PARTITION BY participant) AS sd, i // 5 AS bin FROM f)")
  + " SELECT participant, bin, CAST((bin + 0.5) * 5 AS DOUBLE) AS center_s, round(greatest(-1.5, least(1.5, -regr_slope(v, i) / 5)), 6) AS shift FROM g WHERE sd >= 0.5 GROUP BY participant, bin HAVING count(*) = 5")
def rate_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valence shift of every five samples of a user, from the direction of the valid values."""
    s = _indexed(spark, sf_dir).withColumn("v", F.when(F.col("valid"), F.col("x")))
    return mod.rate_direction(s, ["participant"], "i", "v", 1.0).withColumn("shift", F.round("shift", 6))


@query()
def response_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in every user's task, above the user's mean in the first task."""
    s = samples(spark, sf_dir).withColumn("v", F.when(F.col("valid"), F.col("x")))
    base = s.where("task = 0").groupBy("participant").agg(F.avg("v").alias("base"))
    trace = F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", F.coalesce("v", F.lit(0.0)).alias("v")))), lambda r: r["v"])
    w = s.groupBy("participant", "task").agg(trace.alias("trace"), F.min("t").alias("start"))
    return mod.response_events(w.join(base, "participant", "left"), "trace", "base", "start", 1.0, apart_s=2.0).select("participant", "task", "at", "amplitude")


@query(_with(INDEXED_SQL, "v AS (SELECT participant, i, x, CAST(event_id % 50 AS DOUBLE) AS y, row_number() OVER w AS k, sqrt((x - lag(x) OVER w) ** 2 + (event_id % 50 - lag(event_id % 50) OVER w) ** 2) / (i - lag(i) OVER w) > 30 AS fast FROM ix WHERE valid WINDOW w AS (PARTITION BY participant ORDER BY i))",
  "r AS (SELECT *, k - max(CASE WHEN coalesce(fast, false) THEN 0 ELSE k END) OVER (PARTITION BY participant ORDER BY i) AS run FROM v)")
  + " SELECT participant, ix.i AS i, coalesce(run % 2 = 1, false) AS rejected FROM ix LEFT JOIN r USING (participant, i)")
def velocity_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of a user as a point of a track, and whether it is too far from the one before."""
    s = _indexed(spark, sf_dir).select("participant", "i", F.when(F.col("valid"), F.col("x")).alias("px"), F.when(F.col("valid"), (F.col("event_id") % 50).cast("double")).alias("py"))
    return mod.too_fast(s, ["participant"], "i", ["px", "py"], 30.0).select("participant", "i", "rejected")


@query(_with("a AS (SELECT session, us, avg(x) AS x, CAST(sum(event_id % 50) AS DOUBLE) AS y FROM samples WHERE seat = 0 GROUP BY ALL)", "b AS (SELECT session, us, avg(x) AS x, CAST(sum(event_id % 50) AS DOUBLE) AS y FROM samples WHERE seat = 1 GROUP BY ALL)",
  "n AS (SELECT session FROM (SELECT session, count(*) AS r FROM a GROUP BY ALL) JOIN (SELECT session, count(*) AS l FROM b GROUP BY ALL) USING (session) WHERE r >= 20 AND l >= 20)",
  f"q AS (SELECT b.session, d, b.us - d * {HOUR_US} AS us, b.x, b.y FROM b JOIN n USING (session), (SELECT unnest(range(-6, 7)) AS d))",
  "p AS (SELECT q.*, a.us AS pu, a.x AS px, a.y AS py FROM q ASOF LEFT JOIN a ON q.session = a.session AND q.us >= a.us)", "m AS (SELECT p.*, a.us AS nu, a.x AS nx, a.y AS ny FROM p ASOF LEFT JOIN a ON p.session = a.session AND p.us <= a.us)",
  "e AS (SELECT session, d, sqrt(avg(CASE WHEN nu IS NULL OR us - pu <= nu - us THEN (px - x) ** 2 + (py - y) ** 2 ELSE (nx - x) ** 2 + (ny - y) ** 2 END)) AS rmse FROM m GROUP BY ALL)",
  "o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(rmse, 12), d) AS r FROM e)") + f" SELECT session, d * {HOUR_US} AS delta, round(rmse, 6) AS rmse FROM o WHERE r = 1")
def start_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which shift of whole hours the second seat's samples lie nearest to the first's."""
    s = samples(spark, sf_dir)
    side = lambda k: s.where(F.col("seat") == k).groupBy("session", "us").agg(F.avg("x").alias("x"), F.sum(F.col("event_id") % 50).cast("double").alias("y"))
    return mod.start_delta(side(0), side(1), ["session"], "us", "x", "y", 6, HOUR_US).withColumn("rmse", F.round("rmse", 6))


@query()
def trait_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the other tasks' rows predict a task's spread from its level, rate and share of valid samples."""
    f = _features(spark, sf_dir)
    return mod.regression_scores(mod.left_out_ridge(f, "task", ["eda", "rate", "valid_share"], "pupil_sd"), "pupil_sd", "predicted")


@query(_with(FEATURES_SQL, "t AS (SELECT eda, rate FROM feat WHERE eda IS NOT NULL AND rate IS NOT NULL AND task < 3)", "q AS (SELECT median(eda) AS m, quantile_cont(eda, 0.75) - quantile_cont(eda, 0.25) AS s FROM t)",
  "c AS (SELECT regr_sxy(rate, (eda - m) / s) / (regr_sxx(rate, (eda - m) / s) + 1) AS w, avg(rate) AS y, avg((eda - m) / s) AS x FROM t, q)")
  + " SELECT participant, task, round(greatest(1, least(90, y + w * ((eda - m) / s - x))), 6) AS predicted FROM feat, q, c")
def ridge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak values of all tasks predicted from levels, learnt in the first three tasks."""
    f = _features(spark, sf_dir)
    return mod.robust_ridge(f.where("task < 3"), f, ["eda"], "rate", high=90.0).select("participant", "task", F.round("predicted", 6).alias("predicted"))


@query()
def rebinned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's tasks as normal beliefs, cut at new thresholds."""
    f = _features(spark, sf_dir).select("participant", "task", "eda", F.greatest("pupil_sd", F.lit(0.5)).alias("sigma"))
    return mod.rebinned(f, "eda", "sigma", 20.0, 30.0).select("participant", "task", "soft", "hard")
