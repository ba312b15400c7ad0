"""Queries of the soft labels: signups rate, views are windows, large views are responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import soft_labels as soft
from cohorta.plans.base import DAY_US, SAMPLES_SQL, samples

QUERIES, ORACLE_SQL = {}, {}
DIMS = [soft.Dimension("valence", 5.3, 0.5, 2.1, 0.1, "direction"), soft.Dimension("arousal", 4.9, 2.0, 1.8, 0.2, "response"), soft.Dimension("dominance", 5.1, 0.9, 1.9, 0.1)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = samples(spark, sf_dir).withColumn("t", F.col("us") / DAY_US).withColumn("task", F.concat(F.lit("T"), F.col("task").cast("string")))
    key = ["session", "task", "seat"]
    views = s.where("event_type = 'view'").withColumnRenamed("event_id", "window")
    return {
        "windows": views.select(*key, "window", "t"),
        "reports": s.where("event_type = 'signup'").groupBy(*key, "t").agg((1 + F.max("x") % 8).alias("valence"), (1 + F.max("event_id") % 9).cast("double").alias("arousal"), F.when(F.max("event_id") % 5 != 0, 1 + F.min("x") % 7).alias("dominance")),
        "responses": views.where("x > 60").select(*key, "window", (F.col("t") + 0.01).alias("at"), (F.col("x") / 500).alias("amplitude")),
        "directions": views.select(*key, "window", F.col("t").alias("at"), (F.col("x") % 3 - 1.5).alias("shift")),
    }


def prior():
    return F.when(F.col("dim") == "arousal", soft.by_name({"T0": 0.2, "T2": 0.4, "T3": 0.3, "T4": 0.3}, F.col("task"), 0.35)).otherwise(soft.by_name({"T0": 0.15, "T2": 0.3, "T3": 0.22, "T4": 0.22}, F.col("task"), 0.25))


@query()
def soft_label_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view's soft labels; tests hold the operator against a dense solver."""
    t = tables(spark, sf_dir)
    return soft.soft_labels(t["windows"], t["reports"], t["responses"], t["directions"], DIMS, prior(), width=8.0, near=1.0, absent={"T4": ["dominance"]})


@query("WITH " + SAMPLES_SQL + f""", r AS (SELECT session, 'T' || task AS task, seat, us / {DAY_US} AS t, 1 + max(x) % 8 AS valence, CAST(1 + max(event_id) % 9 AS DOUBLE) AS arousal, CASE WHEN max(event_id) % 5 <> 0 THEN 1 + min(x) % 7 END AS dominance FROM samples WHERE event_type = 'signup' GROUP BY session, task, seat, us),
p AS (SELECT a.session, a.task, a.seat AS k, b.seat AS l, a.t, a.valence AS v1, b.valence AS v2, a.arousal AS a1, b.arousal AS a2, a.dominance AS d1, b.dominance AS d2 FROM r a JOIN r b ON a.session = b.session AND a.task = b.task AND a.seat < b.seat AND abs(a.t - b.t) < 8
  QUALIFY row_number() OVER (PARTITION BY a.session, a.task, a.seat, a.t, b.seat ORDER BY b.t) = 1),
e AS (SELECT session, task, k, l, dim, x, y FROM p, LATERAL (VALUES ('valence', v1, v2), ('arousal', a1, a2), ('dominance', d1, d2)) u(dim, x, y)),
c AS (SELECT session, task, k, l, dim, count(*) AS n, count(x + y) AS m, CASE WHEN count(x + y) > 1 AND stddev_pop(CASE WHEN y IS NOT NULL THEN x END) > 1e-9 AND stddev_pop(CASE WHEN x IS NOT NULL THEN y END) > 1e-9 THEN corr(x, y) END AS c FROM e GROUP BY ALL),
s AS (SELECT DISTINCT session, task, seat FROM r), q AS (SELECT a.session, a.task, a.seat AS k, b.seat AS l, dim FROM s a JOIN s b ON a.session = b.session AND a.task = b.task AND a.seat < b.seat, unnest(['valence', 'arousal', 'dominance']) u(dim)),
o AS (SELECT q.*, round(CASE WHEN coalesce(n, 0) >= 3 THEN CASE WHEN m = n AND c > 0 THEN least(c, 0.95) ELSE 0.05 END
  WHEN dim = 'arousal' THEN CASE task WHEN 'T0' THEN 0.2 WHEN 'T2' THEN 0.4 WHEN 'T3' THEN 0.3 WHEN 'T4' THEN 0.3 ELSE 0.35 END ELSE CASE task WHEN 'T0' THEN 0.15 WHEN 'T2' THEN 0.3 WHEN 'T3' THEN 0.22 WHEN 'T4' THEN 0.22 ELSE 0.25 END END, 6) AS rho FROM q LEFT JOIN c USING (session, task, k, l, dim))
SELECT session, task, k AS seat, l AS other, dim, rho FROM o UNION ALL SELECT session, task, l, k, dim, rho FROM o""")
def seat_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the ratings of two seats of a group go together in each task."""
    r = tables(spark, sf_dir)["reports"]
    a = soft.agreement(r, ["session", "task"], "seat", "t", [d.name for d in DIMS], 8.0, prior())
    return a.select("session", "task", "seat", "other", "dim", F.round("rho", 6).alias("rho"))
