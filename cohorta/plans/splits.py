"""Queries of splits, folds and residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import ranks, splits
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


_COUNTS = """SELECT participant, n, CASE WHEN a + b >= n THEN 1 ELSE a END AS test, CASE WHEN a + b >= n THEN CASE WHEN n > 1 THEN 1 ELSE 0 END ELSE b END AS val
FROM (SELECT participant, count(*) AS n, greatest(round_even(count(*) * 0.2, 0), 1) AS a, greatest(round_even(count(*) * 0.2, 0), 1) AS b FROM samples GROUP BY ALL)"""


@query(_with(f"c AS ({_COUNTS})") + " SELECT participant, CAST(test AS BIGINT) AS test, CAST(val AS BIGINT) AS val, CAST(n - test - val AS BIGINT) AS train FROM c")
def subject_window_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples of each user test, validate and train; which ones they are is up to the seed."""
    s = splits.subject_windows_split(samples(spark, sf_dir).select("participant", "event_id"), "participant", ["event_id"])
    return s.groupBy("participant").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("test", "val", "train")])


@query()
def subject_window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.subject_windows_split(samples(spark, sf_dir).select("participant", "event_id"), "participant", ["event_id"])


@query()
def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders in five folds of about equal size; tests hold the greedy rule against a loop over groups."""
    return splits.balanced_group_folds(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 5)


@query()
def fold_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tertiles of prices outside each of five folds of customers."""
    f = splits.balanced_group_folds(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), "o_custkey", 5)
    return splits.refitted(f, "fold", lambda df, keys: ranks.tertiles(df, keys, "o_totalprice"), [])


_TWO = """WITH v AS (SELECT l_returnflag AS k, l_extendedprice AS x, l_discount * l_quantity AS y, l_quantity AS a, l_tax + l_quantity / 100 AS b FROM lineitem),
c AS (SELECT k, count(*) AS n, corr(x, y) AS xy, corr(x, a) AS xa, corr(x, b) AS xb, corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab FROM v GROUP BY k),
p AS (SELECT k, n, (xy - xa * ya) / sqrt((1 - xa * xa) * (1 - ya * ya)) AS xy, (xb - xa * ab) / sqrt((1 - xa * xa) * (1 - ab * ab)) AS xb, (yb - ya * ab) / sqrt((1 - ya * ya) * (1 - ab * ab)) AS yb FROM c)"""


@query(_TWO + " SELECT k, n, round((xy - xb * yb) / sqrt((1 - xb * xb) * (1 - yb * yb)), 8) AS r FROM p")
def partial_correlation_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and discounted quantity after fits on quantity and tax, by return flag."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("x"), (F.col("l_discount") * F.col("l_quantity")).alias("y"), F.col("l_quantity").alias("a"), (F.col("l_tax") + F.col("l_quantity") / 100).alias("b"))
    return splits.partial_correlations(li, ["k"], "x", "y", ["a", "b"]).select("k", "n", F.round("r", 8).alias("r"))


@query("""WITH v AS (SELECT o_orderpriority AS k, o_orderkey, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS a FROM orders), f AS (SELECT k, regr_slope(y, a) AS b, avg(y) AS my, avg(a) AS ma, count(*) AS n FROM v GROUP BY k)
SELECT o_orderkey, round(y - my - b * (a - ma), 4) AS residual FROM v JOIN f USING (k) WHERE n >= 4""")
def price_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), "o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("a"))
    return splits.residuals(o, ["k"], "y", ["a"]).select("o_orderkey", F.round("residual", 4).alias("residual"))


@query(_with() + """ SELECT event_id, CASE task WHEN 3 THEN 'test' WHEN 2 THEN 'val' WHEN 1 THEN 'train' ELSE 'baseline' END AS role, 3 AS test FROM samples WHERE task <= 3
UNION ALL SELECT event_id, CASE task WHEN 1 THEN 'test' ELSE 'val' END, 1 FROM samples WHERE task <= 1 UNION ALL SELECT event_id, 'train', 1 FROM samples WHERE task = 0""")
def task_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test task 3 with the first task as baseline, and test task 1, whose validating task trains too."""
    s = samples(spark, sf_dir).select("event_id", "task")
    parts = [splits.task_roles(s, "task", [0, 1, 2, 3, 4], t, rest).select("event_id", "role", F.lit(t).alias("test")) for t, rest in ((3, "baseline-only"), (1, "train"))]
    return parts[0].unionByName(parts[1])


@query(_with("f AS (SELECT DISTINCT participant AS fold FROM samples WHERE task = 3)",
  "r AS (SELECT fold, CASE WHEN participant = fold THEN CASE WHEN task = 3 THEN 'test' END WHEN task <= 1 THEN 'train' WHEN task = 2 THEN 'val' END AS role, x FROM f, samples)")
  + " SELECT fold, role, count(*) AS n, round(avg(x), 8) AS mean FROM r WHERE role IS NOT NULL GROUP BY ALL")
def subject_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user held out: tested on task 3, the others train on tasks 0 and 1 and validate on task 2."""
    f = splits.subject_folds(samples(spark, sf_dir), "participant", "task", "x", [0, 1], 2, 1, 3)
    return f.where("n > 0").select("fold", "role", "n", F.round("mean", 8).alias("mean"))


@query(_with("w AS (SELECT session, task, count(DISTINCT participant) AS participants, count(*) AS rows FROM samples GROUP BY ALL)",
  "l AS (SELECT session, task, 'x' AS feature, CASE WHEN valid THEN x END AS v FROM samples UNION ALL SELECT session, task, 'y', CAST(event_id % 50 AS DOUBLE) FROM samples)")
  + " SELECT l.session, l.task, feature, any_value(participants) AS participants, any_value(w.rows) AS \"rows\", count(v) AS n, round(avg(v), 8) AS mean, round(quantile_cont(v, 0.5), 8) AS median FROM l JOIN w ON w.session = l.session AND w.task = l.task GROUP BY l.session, l.task, feature")
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("session", "task", "participant", F.when(F.col("valid"), F.col("x")).alias("x"), (F.col("event_id") % 50).alias("y"))
    t = splits.task_summary(s, ["session", "task"], "participant", ["x", "y"])
    return t.select("session", "task", "feature", "participants", "rows", "n", F.round("mean", 8).alias("mean"), F.round("median", 8).alias("median"))
