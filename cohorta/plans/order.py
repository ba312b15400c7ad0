"""Queries of exact ranks, percentiles and as-of joins that no key's size troubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import asof, ranks
from cohorta.plans.base import DAY_US, SAMPLES_SQL, samples, table

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


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS r FROM lineitem)
SELECT l_returnflag, v, max(r) AS rank, count(*) AS n FROM r GROUP BY ALL""")
def price_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices ranked within three keys that hold all rows."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v"))
    return ranks.ranked(li, ["l_returnflag"], "v", "rank").groupBy("l_returnflag", "v").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))


@query("""SELECT l_linestatus, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95
FROM lineitem GROUP BY l_linestatus""")
def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ranks.percentiles(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return p.select("l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("p05", "median", "p95")])


_RANK = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
_FEATURES = ("l_discount", "l_extendedprice", "l_quantity", "l_tax")


@query("WITH r AS (SELECT *, " + ", ".join(f"{_RANK(c)} AS r_{c}" for c in _FEATURES) + " FROM lineitem) "
  + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 8) AS pearson, round(corr(r_{a}, r_{b}), 8) AS spearman FROM r" for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :]))
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of four measures of all lines, each ranked once over ranges of its values."""
    c = ranks.correlations(table(spark, sf_dir, "lineitem"), list(_FEATURES))
    return c.select("a", "b", "n", F.round("pearson", 8).alias("pearson"), F.round("spearman", 8).alias("spearman"))


@query("""WITH s AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
c AS (SELECT l_returnflag, max(v) FILTER (i = n // 3) AS c1, max(v) FILTER (i = 2 * n // 3) AS c2 FROM s GROUP BY ALL),
t AS (SELECT c.l_returnflag, coalesce((c1 + max(v) FILTER (v < c1)) / 2, c1 - 0.5) AS t1, coalesce((c2 + max(v) FILTER (v < c2)) / 2, c2 - 0.5) AS t2 FROM c JOIN s USING (l_returnflag) GROUP BY c.l_returnflag, c1, c2)
SELECT t.l_returnflag, round(t1, 6) AS t1, round(CASE WHEN t2 > t1 THEN t2 ELSE coalesce((t1 + (SELECT min(v) FROM s WHERE s.l_returnflag = t.l_returnflag AND v > t1 + 0.5)) / 2, t1 + 1) END, 6) AS t2 FROM t""")
def price_tertiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ranks.tertiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return t.select("l_returnflag", F.round("t1", 6).alias("t1"), F.round("t2", 6).alias("t2"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's place among all by price, without one task that sorts them."""
    return ranks.row_numbers(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


_NEAR = """l AS (SELECT event_id, event_type, us FROM samples WHERE seat = 0), r AS (SELECT event_type, us, max(x) AS x_last, min(x) AS x_first FROM samples WHERE seat = 1 GROUP BY ALL),
b AS (SELECT l.event_id, l.us, r.us AS p, r.x_last AS pv FROM l ASOF LEFT JOIN r ON l.event_type = r.event_type AND l.us >= r.us),
a AS (SELECT l.event_id, r.us AS n, r.x_first AS nv FROM l ASOF LEFT JOIN r ON l.event_type = r.event_type AND l.us <= r.us)"""


@query(_with(_NEAR) + """ SELECT event_id, CASE WHEN n IS NULL OR us - p <= n - us THEN p ELSE n END AS near_at, round(CASE WHEN n IS NULL OR us - p <= n - us THEN pv ELSE nv END, 9) AS near_value FROM b JOIN a USING (event_id)""")
def nearest_of_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest sample in time of another seat with the same event type: a handful of keys, cut into days."""
    s = samples(spark, sf_dir)
    left = s.where("seat = 0").select("event_id", "event_type", "us")
    n = asof.nearest(left, s.where("seat = 1").select("event_type", "us", "x"), ["event_type"], "us", "x", DAY_US)
    return n.select("event_id", "near_at", F.round("near_value", 9).alias("near_value"))


@query(_with(_NEAR, "f AS (SELECT event_type, min(us) AS f, min_by(x_first, us) AS fv FROM r GROUP BY ALL)")
  + " SELECT b.event_id, round(CASE WHEN p IS NULL THEN fv ELSE pv END, 9) AS x FROM b JOIN l USING (event_id) LEFT JOIN f USING (event_type)")
def last_of_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    left = s.where("seat = 0").select("event_id", "event_type", "us")
    b = asof.backward(left, s.where("seat = 1").select("event_type", "us", "x"), ["event_type"], "us", ["x"], DAY_US)
    return b.select("event_id", F.round("x", 9).alias("x"))


@query(_with(f"b AS (SELECT event_type, min(us) AS a, max(us) AS z FROM samples GROUP BY ALL)", f"g AS (SELECT event_type, a + i * {DAY_US // 4} AS us FROM b, unnest(range(0, (z - a) // {DAY_US // 4} + 1)) u(i))", "r AS (SELECT DISTINCT event_type, us FROM samples)",
  "p AS (SELECT g.event_type, g.us, r.us AS p FROM g ASOF LEFT JOIN r ON g.event_type = r.event_type AND g.us >= r.us)", "n AS (SELECT g.event_type, g.us, r.us AS n FROM g ASOF LEFT JOIN r ON g.event_type = r.event_type AND g.us <= r.us)",
  "m AS (SELECT event_type, us, CASE WHEN n IS NULL OR us - p <= n - us THEN p ELSE n END AS m FROM p JOIN n USING (event_type, us))")
  + f" SELECT event_type, us, CASE WHEN abs(m - us) <= {DAY_US // 48} THEN m END AS near_at, CAST(abs(m - us) > {DAY_US // 48} AS INTEGER) AS is_missing FROM m")
def grid_of_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row each six hours of each event type: its sample within half an hour, or none."""
    g = asof.on_grid(samples(spark, sf_dir).select("event_type", "us", "x"), ["event_type"], "us", "x", DAY_US // 4, DAY_US // 48)
    return g.select("event_type", "us", "near_at", "is_missing")
