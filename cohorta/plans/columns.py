"""Queries of column functions that no other query uses: adaptive classes, scales, maps, normalised answers, accepted labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.functions import scalars as sc
from cohorta.operators import evaluate
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


@query(_with("t AS (SELECT session, CASE WHEN session % 3 <> 0 THEN quantile_cont(x, 0.33) END AS t1, CASE WHEN session % 5 <> 0 THEN quantile_cont(x, 0.67) END AS t2, avg(x) AS m, CASE WHEN session % 7 = 0 THEN 0 ELSE stddev_pop(x) END AS s FROM samples GROUP BY session)")
  + """ SELECT event_id, CASE WHEN NOT valid THEN 1 WHEN x <= coalesce(t1, 4) THEN 0 WHEN x <= coalesce(t2, 6) THEN 1 ELSE 2 END AS class, round(CASE WHEN s >= 1e-6 THEN least(greatest((x - m) / s * 1.85 + 6.22, 1), 9) END, 8) AS scaled,
  round(least(greatest(1 + (x / 100 - 0.8) / 1.4, 1), 2.5), 9) AS heat, round((x + coalesce(CASE WHEN valid THEN task END, x)) / 2 - coalesce(CASE WHEN valid THEN seat END, 0), 9) AS arousal FROM samples JOIN t USING (session)""")  # fmt: skip
def adaptive_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by a group's own tertiles where it has them, values on the rating scale, temperatures, and a difference of means."""
    s = samples(spark, sf_dir)
    k = F.col("session")
    t = s.groupBy("session").agg(F.percentile("x", F.lit(0.33)).alias("a"), F.percentile("x", F.lit(0.67)).alias("b"), F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    t = t.select("session", F.when(k % 3 != 0, F.col("a")).alias("t1"), F.when(k % 5 != 0, F.col("b")).alias("t2"), "m", F.when(k % 7 == 0, 0.0).otherwise(F.col("sd")).alias("s"))
    given = lambda c: F.when(F.col("valid"), F.col(c))
    arousal = sc.minus_means([F.col("x"), given("task").cast("double")], [given("seat").cast("double")])
    out = s.join(t, "session").select("event_id", sc.adaptive_class(given("x"), F.col("t1"), F.col("t2")).alias("class"), sc.rescale(F.col("x"), F.col("m"), F.col("s")).alias("scaled"), sc.temperature(F.col("x") / 100, 0.8, 1.4).alias("heat"), F.when(F.col("valid"), arousal).otherwise(F.col("x")).alias("arousal"))
    return out.select("event_id", "class", *[F.round(c, d).alias(c) for c, d in (("scaled", 8), ("heat", 9), ("arousal", 9))])


_ANSWERS = [("medium", "middle"), ("high", "top"), ("urgent", "top"), ("low", "bottom")]


@query("""SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%medium%' THEN 'middle' WHEN lower(o_orderpriority) LIKE '%high%' THEN 'top' WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'top' WHEN lower(o_orderpriority) LIKE '%low%' THEN 'bottom' ELSE 'n/a' END AS answer,
list_transform(['F', 'O', 'P'], lambda v: CASE WHEN o_orderstatus = v THEN 1 ELSE 0 END)[1] AS is_f, list_transform(['F', 'O', 'P'], lambda v: CASE WHEN o_orderstatus = v THEN 1 ELSE 0 END)[2] AS is_o,
strftime(o_orderdate + INTERVAL 10 YEAR, '%Y%m%d') AS date, 'grp-' || lpad(CAST(o_custkey % 90 AS VARCHAR), 2, '0') AS "group", 'run' || lpad(CAST(o_orderkey % 9 AS VARCHAR), 2, '0') AS run FROM orders""")
def normalised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text by its first known part, one-hot status, and the date, group and run that a name spells."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("study_"), F.date_format(F.add_months("o_orderdate", 120), "yyyy-MM-dd"), F.lit("_Group-0"), (F.col("o_custkey") % 90).cast("string"), F.lit("_RUN_"), (F.col("o_orderkey") % 9).cast("string"))
    hot, sign = sc.one_hot(F.col("o_orderstatus"), ["F", "O", "P"]), sc.session_signature(name)
    return o.select("o_orderkey", sc.first_match(F.col("o_orderpriority"), _ANSWERS).alias("answer"), F.get(hot, 0).alias("is_f"), F.get(hot, 1).alias("is_o"), sign["date"].alias("date"), sign["group"].alias("group"), sign["run"].alias("run"))


@query(_with("w AS (SELECT event_id, task, [x, 50.0, event_id % 100] AS v, x / 300 AS weight FROM samples)", "s AS (SELECT *, list_transform(v, lambda e: e / list_sum(v)) AS soft FROM w)")
  + " SELECT event_id, CAST(list_position(soft, list_max(soft)) - 1 AS INTEGER) AS label, round(list_max(soft), 9) AS share FROM s WHERE weight >= 0.2 AND list_max(soft) >= 0.5")
def accepted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.array(F.col("x"), F.lit(50.0), (F.col("event_id") % 100).cast("double"))
    total = F.aggregate(v, F.lit(0.0), lambda a, e: a + e)
    s = samples(spark, sf_dir).select("event_id", F.transform(v, lambda e: e / total).alias("soft"), (F.col("x") / 300).alias("weight"))
    return evaluate.accepted_pseudo_labels(s, "soft", "weight", 0.2).select("event_id", "label", F.round(F.array_max("soft"), 9).alias("share"))
