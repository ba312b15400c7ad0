"""Queries of checks of labels and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.functions.scalars import rating_class
from cohorta.operators import checks
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


_RATED = "f AS (SELECT participant, task, avg(x) AS eda, 1 + sum(event_id) % 9 AS y FROM samples GROUP BY ALL)"
_LEFT_OUT = """c AS (SELECT *, row_number() OVER (ORDER BY participant, task) AS i FROM f WHERE eda IS NOT NULL),
q AS (SELECT a.i, any_value(a.participant) AS participant, any_value(a.task) AS task, any_value(a.y) AS y, any_value(a.eda) AS eda, quantile_cont(b.eda, 0.75) - quantile_cont(b.eda, 0.25) AS iqr, avg(b.eda) AS mx, avg(b.y) AS my, regr_sxy(b.y, b.eda) AS sxy, regr_sxx(b.y, b.eda) AS sxx FROM c a JOIN c b ON a.i <> b.i GROUP BY a.i),
s AS (SELECT *, CASE WHEN iqr = 0 THEN 1 ELSE iqr END AS sc FROM q), p AS (SELECT participant, task, y, greatest(1, least(9, my + (sxy / sc) / (sxx / sc / sc + 1) * (eda - mx) / sc)) AS predicted FROM s)"""


def _left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's tasks rated by what their event numbers add up to."""
    f = samples(spark, sf_dir).groupBy("participant", "task").agg(F.avg("x").alias("eda"), (1 + F.sum("event_id") % 9).alias("y"))
    return checks.left_one_out_ridge(f, ["eda"], "y")


@query(_with(_RATED, _LEFT_OUT) + " SELECT participant, task, y, round(predicted, 6) AS predicted FROM p")
def left_one_out_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _left_out(spark, sf_dir).select("participant", "task", "y", F.round("predicted", 6).alias("predicted"))


@query(_with(_RATED, _LEFT_OUT, "w AS (SELECT *, round(predicted, 9) AS r FROM p)", "k AS (SELECT *, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS rp, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS rt FROM w)")
  + " SELECT count(*) AS n, round(avg(abs(r - y)), 6) AS mae, round(corr(rp, rt), 6) AS rho, round(avg(CASE WHEN (r >= 3.5)::INT + (r >= 6.5)::INT = (y >= 3.5)::INT + (y >= 6.5)::INT THEN 1.0 ELSE 0 END), 6) AS acc3, round(avg(CASE WHEN abs(r - y) <= 1 THEN 1.0 ELSE 0 END), 6) AS acc_near FROM k")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = checks.label_scores(_left_out(spark, sf_dir).withColumn("r", F.round("predicted", 9)), "r", "y")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "rho", "acc3", "acc_near")])


_ROLES = [(t, m) for t in ("T0", "T1", "T4") for m in ("train", "exclude")]


@query(_with("""r(test, mode, task, role) AS (VALUES ('T4', 'train', 0, 'train'), ('T4', 'train', 1, 'train'), ('T4', 'train', 2, 'train'), ('T4', 'train', 3, 'val'), ('T4', 'train', 4, 'test'), ('T4', 'exclude', 1, 'train'), ('T4', 'exclude', 2, 'train'), ('T4', 'exclude', 3, 'val'), ('T4', 'exclude', 4, 'test'),
  ('T1', 'train', 0, 'train'), ('T1', 'train', 0, 'val'), ('T1', 'train', 1, 'test'), ('T1', 'exclude', 0, 'val'), ('T1', 'exclude', 1, 'test'), ('T0', 'train', 0, 'train'), ('T0', 'train', 1, 'train'), ('T0', 'train', 2, 'train'), ('T0', 'train', 3, 'train'), ('T0', 'train', 0, 'val'), ('T0', 'train', 0, 'test'),
  ('T0', 'exclude', 1, 'train'), ('T0', 'exclude', 2, 'train'), ('T0', 'exclude', 3, 'train'), ('T0', 'exclude', 0, 'val'), ('T0', 'exclude', 0, 'test'))""")
  + " SELECT test, mode, participant, role, count(*) AS n, sum(event_id) AS ids FROM samples JOIN r USING (task) GROUP BY ALL")
def task_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and event numbers of every role, by test task and by what becomes of the first task."""
    s = samples(spark, sf_dir).select("participant", "event_id", F.concat(F.lit("T"), F.col("task").cast("string")).alias("task"))
    out = None
    for test, mode in _ROLES:
        r = checks.task_roles(s, "task", test, first=mode).groupBy("participant", "role").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select(F.lit(test).alias("test"), F.lit(mode).alias("mode"), "participant", "role", "n", "ids")
        out = r if out is None else out.unionByName(r)
    return out


@query(_with() + """ SELECT DISTINCT 'checked' AS kind, session, task, seat FROM samples WHERE event_type = 'error' UNION ALL SELECT DISTINCT 'union', session, task, seat FROM samples WHERE event_type IN ('view', 'signup')""")
def expected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a checked table, and, where that table is empty, of two others."""
    s, keys = samples(spark, sf_dir), ["session", "task", "seat"]
    checked, others = s.where("event_type = 'error'"), [s.where("event_type = 'view'"), s.where("event_type = 'signup'")]
    some = checks.expected_keys(checked, others, keys).select(F.lit("checked").alias("kind"), *keys)
    return some.unionByName(checks.expected_keys(checked.where("event_type = 'none'"), others, keys).select(F.lit("union").alias("kind"), *keys))


@query(_with("""g AS (SELECT session, list(DISTINCT 's' || task) FILTER (event_type = 'view' AND session % 4 > 0) AS l, list(DISTINCT 's' || (CASE WHEN session % 3 = 0 THEN task ELSE task + 9 END)) FILTER (event_type = 'click') AS r,
  coalesce(list(DISTINCT participant) FILTER (event_type = 'view' AND session % 4 > 0), []) AS a, coalesce(list(DISTINCT participant + (CASE WHEN session % 5 = 0 THEN 1000 ELSE 0 END)) FILTER (event_type = 'click'), []) AS b FROM samples WHERE event_type = 'click' OR (event_type = 'view' AND session % 4 > 0) GROUP BY session)""",
  "c AS (SELECT session, l IS NOT NULL AND r IS NOT NULL AS both_, len(list_intersect(coalesce(l, []), coalesce(r, []))) > 0 AS same, session % 2 = 0 AS signed, len(list_intersect(a, b)) > 0 AS shared FROM g)")
  + """ SELECT session, CASE WHEN NOT both_ THEN 'single-source' WHEN same OR (signed AND shared) THEN 'high' WHEN signed THEN 'medium' ELSE 'low' END AS quality,
  concat_ws('|', CASE WHEN same THEN 'exact_session_name' END, CASE WHEN signed THEN 'normalized_date_group_run' END, CASE WHEN shared THEN 'participant_id_overlap' END) AS cues FROM c""")  # fmt: skip
def match_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of three sessions of four as one root and clicks as another, where some names and participants differ."""
    s = samples(spark, sf_dir).where("event_type = 'click' or (event_type = 'view' and session % 4 > 0)")
    left = F.col("event_type") == "view"
    name = F.concat(F.lit("s"), F.when(left | (F.col("session") % 3 == 0), F.col("task")).otherwise(F.col("task") + 9).cast("string"))
    who = F.col("participant") + F.when(~left & (F.col("session") % 5 == 0), 1000).otherwise(0)
    rows = s.select("session", F.when(left, "left").otherwise("right").alias("side"), name.alias("name"), F.array(who).alias("ids"), (F.col("session") % 2 == 0).alias("signed"))
    return checks.match_cues(rows, "session", "side", "name", "ids", "signed").withColumn("cues", F.array_join("cues", "|"))


@query(_with() + " SELECT event_id, CASE WHEN NOT valid OR x IS NULL THEN -1 WHEN x <= 20 THEN 0 WHEN x <= 60 THEN 1 ELSE 2 END AS class FROM samples")
def hard_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with -1 where there is no rating."""
    return samples(spark, sf_dir).select("event_id", rating_class(F.when(F.col("valid"), F.col("x")), 20, 60, -1).alias("class"))
