"""Queries of the group operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import group
from cohorta.plans.base import DAY_US, SAMPLES_SQL, samples, table
from cohorta.plans.windows import PER_TASK_SQL, per_task

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


def _rounded(df: DataFrame, *keep: str, places: int = 9) -> DataFrame:
    return df.select(*[c if c in keep or t not in ("double", "float") else F.round(c, places).alias(c) for c, t in df.dtypes])


@query(_with() + " SELECT session, task, count(DISTINCT participant) AS members, round(avg(x), 9) AS x_mean, round(stddev_pop(x), 9) AS x_sd FROM samples GROUP BY ALL")
def group_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(group.group_window(samples(spark, sf_dir), ["session", "task"], "participant", ["x"]))


@query(_with(f"b AS (SELECT session, us // {DAY_US} AS bucket, seat, sum(x) AS speech FROM samples WHERE event_type = 'view' GROUP BY ALL)",
  "s AS (SELECT *, sum(speech) OVER w AS total, CASE WHEN sum(speech) OVER w >= 0.01 THEN speech / sum(speech) OVER w ELSE 0 END AS share, coalesce(stddev_samp(speech) OVER w, 0) AS spread, count(*) FILTER (WHERE speech > 0) OVER w AS active FROM b WINDOW w AS (PARTITION BY session, bucket))")
  + " SELECT session, bucket, seat, round(total, 6) AS total, round(share, 9) AS share, round(spread, 6) AS spread, active, round(coalesce(-sum(CASE WHEN share > 0 THEN share * ln(share) END) OVER (PARTITION BY session, bucket), 0), 9) AS entropy FROM s")
def speech_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as speech: shares, spread and entropy within each group's days."""
    b = samples(spark, sf_dir).where("event_type = 'view'").groupBy("session", F.floor(F.col("us") / DAY_US).alias("bucket"), "seat").agg(F.sum("x").alias("speech"))
    d = group.speech_dynamics(b, ["session", "bucket"], "seat", "speech")
    return d.select("session", "bucket", "seat", F.round("total", 6).alias("total"), F.round("share", 9).alias("share"), F.round("spread", 6).alias("spread"), "active", F.round("entropy", 9).alias("entropy"))


@query(_with() + " SELECT session, round(CASE WHEN count(*) >= 3 THEN corr(x, us / 1e9) END, 8) AS r FROM samples WHERE valid GROUP BY ALL")
def trend_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("y", F.when(F.col("valid"), F.col("us") / 1e9))
    return s.groupBy("session").agg(F.round(group.pearson("x", "y"), 8).alias("r"))


@query(_with(f"e AS (SELECT session, us // {DAY_US // 2} AS b, avg(x) FILTER (WHERE seat = 0) AS x, avg(x) FILTER (WHERE seat = 1) AS y FROM samples GROUP BY ALL)",
  "r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY b) AS i FROM e WHERE x IS NOT NULL OR y IS NOT NULL)",
  "l AS (SELECT a.session, k, CASE WHEN count(*) FILTER (WHERE a.x IS NOT NULL AND c.y IS NOT NULL) >= 3 THEN corr(a.x, c.y) END AS r FROM r a, unnest(range(-2, 3)) u(k), r c WHERE c.session = a.session AND c.i = a.i + k GROUP BY ALL)")
  + " SELECT session, CAST(arg_max(k, (round(r, 12), -k)) AS INTEGER) AS lag, round(max(r), 9) AS r FROM l WHERE r IS NOT NULL GROUP BY session")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag, in half days, at which the first two seats of a group go together best."""
    b = F.floor(F.col("us") / (DAY_US // 2)).alias("b")
    e = samples(spark, sf_dir).groupBy("session", b).agg(F.avg(F.when(F.col("seat") == 0, F.col("x"))).alias("x"), F.avg(F.when(F.col("seat") == 1, F.col("x"))).alias("y"))
    return _rounded(group.best_lag(e, ["session"], "b", "x", "y"))


@query("""WITH u AS (SELECT l_returnflag, unnest(['discount', 'price', 'quantity']) AS feature, unnest([l_discount, l_extendedprice / 1000, l_quantity]) AS v FROM lineitem)
SELECT l_returnflag, feature, count(*) AS n, round(avg(v), 8) AS mean, round(quantile_cont(v, 0.5), 8) AS median, round(stddev_samp(v), 8) AS sd, round(quantile_cont(v, 0.25), 8) AS p25, round(quantile_cont(v, 0.75), 8) AS p75,
  round(stddev_samp(v) / sqrt(count(*)), 8) AS sem, round(avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*)), 8) AS low, round(avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*)), 8) AS high, round(avg(v) / stddev_samp(v), 8) AS effect FROM u GROUP BY ALL""")
def series_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of several numbers of lineitem, unpivoted, by return flag."""
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_discount").alias("discount"), (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("quantity"))
    u = group.unpivot(df, ["l_returnflag"], ["discount", "price", "quantity"])
    return _rounded(group.series(u, ["l_returnflag", "feature"], "value"), places=8)


@query(_with(PER_TASK_SQL, "b AS (SELECT participant, m AS base FROM per_task WHERE task = 0)") + " SELECT task, count(*) AS n, round(avg(m - base), 9) AS mean, round(stddev_samp(m - base), 9) AS sd FROM per_task JOIN b USING (participant) WHERE task > 0 GROUP BY task")
def task_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each later task's change from the first, over all users."""
    p = per_task(spark, sf_dir)
    base = p.where("task = 0").select("participant", F.col("m").alias("base"))
    d = p.where("task > 0").join(base, "participant").withColumn("delta", F.col("m") - F.col("base"))
    return _rounded(group.series(d, ["task"], "delta").select("task", "n", "mean", "sd"))


RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"
_PAIRS = [("l_discount", "l_extendedprice"), ("l_discount", "l_quantity"), ("l_extendedprice", "l_quantity")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 8) AS pearson, round(corr(ra, rb), 8) AS spearman FROM (SELECT {a}, {b}, {RANK.format(a)} AS ra, {RANK.format(b)} AS rb FROM lineitem)" for a, b in _PAIRS))
def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(group.pair_correlations(table(spark, sf_dir, "lineitem"), [], ["l_quantity", "l_discount", "l_extendedprice"]), places=8)


@query("""WITH c AS (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem GROUP BY ALL)
SELECT l_returnflag, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 8) AS r FROM c""")
def motion_adjusted_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(group.partial_correlation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", "l_discount"), places=8)


@query("""SELECT 'balance' AS feature, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS usable, round(100.0 * count(CASE WHEN c_acctbal > 0 THEN 1 END) / count(*), 9) AS of_observed, round(100.0 * count(CASE WHEN c_acctbal > 0 THEN 1 END) / 2000, 9) AS of_expected FROM customer
UNION ALL SELECT 'nation', count(nullif(c_nationkey, 3)), round(100.0 * count(nullif(c_nationkey, 3)) / count(*), 9), round(100.0 * count(nullif(c_nationkey, 3)) / 2000, 9) FROM customer""")
def feature_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    return _rounded(group.usability(c, ["balance", "nation"], 2000))


@query(_with("e AS (SELECT DISTINCT session, task, seat FROM samples)", "a AS (SELECT DISTINCT session, task, seat, 1 AS view FROM samples WHERE event_type = 'view')", "b AS (SELECT DISTINCT session, task, seat, 1 AS click FROM samples WHERE event_type = 'click')")
  + """ SELECT session, task, count(*) AS expected, count(view) AS views, count(click) AS clicks, count(CASE WHEN view = 1 AND click = 1 THEN 1 END) AS all_sides, round(100.0 * count(view) / count(*), 9) AS views_pct FROM e LEFT JOIN a USING (session, task, seat) LEFT JOIN b USING (session, task, seat) GROUP BY ALL""")
def modality_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    keys = ["session", "task", "seat"]
    c = group.coverage(s.select(*keys).distinct(), keys, ["session", "task"], {"views": s.where("event_type = 'view'"), "clicks": s.where("event_type = 'click'")})
    return c.select("session", "task", "expected", "views", "clicks", F.col("all_sides").cast("long").alias("all_sides"), F.round("views_pct", 9).alias("views_pct"))


@query(_with("q AS (SELECT task, concat_ws(';', CASE WHEN x > 100 THEN 'high' END, CASE WHEN NOT valid THEN 'invalid' END, CASE WHEN seat = 0 THEN 'first_seat' END) AS f FROM samples)", "n AS (SELECT task, count(*) AS total FROM q GROUP BY ALL)",
  "e AS (SELECT task, unnest(string_split(f, ';')) AS flag FROM q)")
  + " SELECT task, flag, count(*) AS n, any_value(total) AS \"rows\", round(100.0 * count(*) / any_value(total), 9) AS pct FROM e JOIN n USING (task) WHERE flag <> '' GROUP BY task, flag")
def qc_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.concat_ws(";", F.when(F.col("x") > 100, "high"), F.when(~F.col("valid"), "invalid"), F.when(F.col("seat") == 0, "first_seat"))
    return _rounded(group.flag_counts(samples(spark, sf_dir).withColumn("f", f), ["task"], "f"))


@query("""SELECT n_regionkey, count(*) AS "rows", round(avg(c_acctbal), 6) AS c_acctbal_mean, round(stddev_pop(c_acctbal), 6) AS c_acctbal_sd, round(avg(c_custkey), 6) AS c_custkey_mean, round(stddev_pop(c_custkey), 6) AS c_custkey_sd
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def group_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of customer, pooled by region."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey", "c_acctbal")
    return _rounded(group.pooled(c, ["n_regionkey"]), places=6)


@query(_with(PER_TASK_SQL) + " SELECT participant, task, round(m - avg(m) OVER w, 9) AS delta, round(CASE WHEN stddev_pop(m) OVER w > 0 THEN (m - avg(m) OVER w) / stddev_pop(m) OVER w END, 8) AS z FROM per_task WINDOW w AS (PARTITION BY session, task)")
def participant_against_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = group.against_group(per_task(spark, sf_dir), ["session", "task"], "m")
    return g.select("participant", "task", F.round("delta", 9).alias("delta"), F.round("z", 8).alias("z"))


@query("""WITH o AS (SELECT o_orderpriority, CASE WHEN o_totalprice > 250000 THEN 'H' WHEN o_totalprice > 50000 THEN 'L' ELSE '' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'H' WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'L' END AS b FROM orders)
SELECT o_orderpriority, count(*) FILTER (WHERE a <> '' AND b IS NOT NULL) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) FILTER (WHERE a <> '' AND b IS NOT NULL), 9) AS agreement FROM o GROUP BY ALL""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(p > 250000, "H").when(p > 50000, "L").otherwise("").alias("a"), F.when(k % 3 == 0, "H").when(k % 7 == 0, F.lit(None)).otherwise("L").alias("b"))
    return _rounded(group.agreement(o, ["o_orderpriority"], "a", "b"))


@query(_with() + """ SELECT session, task, count(*) AS answers, round(avg(x) FILTER (WHERE event_type = 'view'), 9) AS view_mean, round(avg(x) FILTER (WHERE event_type = 'click'), 9) AS click_mean,
  coalesce(list_aggregate(list_sort(list(DISTINCT CAST(seat AS VARCHAR)) FILTER (WHERE event_type = 'view')), 'string_agg', '|'), '') AS view_seats FROM samples GROUP BY ALL""")  # fmt: skip
def answers_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    a = group.answers_wide(s.withColumn("text", F.col("x").cast("string")), ["session", "task"], "event_type", "text", ["view", "click"]).select("session", "task", "answers", "view_mean", "click_mean")
    b = group.answers_wide(s.withColumn("text", F.col("seat").cast("string")), ["session", "task"], "event_type", "text", ["view"]).select("session", "task", F.col("view_text").alias("view_seats"))
    return _rounded(a.join(b, ["session", "task"]))


@query(_with("f AS (SELECT participant, task, arg_min(x, us) FILTER (WHERE event_type = 'view') AS view, arg_min(x, us) FILTER (WHERE event_type = 'click') AS click, arg_min(x, us) FILTER (WHERE event_type = 'error') AS error FROM samples GROUP BY ALL)")
  + " SELECT * FROM f WHERE view IS NOT NULL AND click IS NOT NULL")
def first_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.first_values(samples(spark, sf_dir), ["participant", "task"], "event_type", "x", "us", ["view", "click", "error"], ["view", "click"])


@query(_with() + " SELECT participant, round(avg(x) FILTER (WHERE event_type = 'click'), 9) AS click, round(avg(x) FILTER (WHERE event_type = 'view'), 9) AS view FROM samples GROUP BY ALL")
def questionnaire_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(group.item_means(samples(spark, sf_dir), ["participant"], "event_type", "x", ["click", "view"]))


@query("""WITH k AS (SELECT n_nationkey, n_regionkey AS domain FROM nation)
SELECT c_mktsegment AS person, domain, round(avg(c_acctbal), 3) AS score FROM customer JOIN k ON c_nationkey = n_nationkey GROUP BY ALL""")
def trait_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as items of the regions' domains, market segments as persons."""
    a = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("person"), F.col("c_nationkey").alias("item"), "c_acctbal")
    return group.trait_scores(a, "person", "item", "c_acctbal", table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item"), F.col("n_regionkey").alias("domain")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.rolled_up(table(spark, sf_dir, "lineitem"), [["l_returnflag"], ["l_linestatus"], []], [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")])


@query(_with("a AS (SELECT task AS name, avg(x) - (SELECT avg(x) FROM samples) AS v FROM samples GROUP BY ALL)", "b AS (SELECT session AS name, avg(x) - 50 AS v FROM samples GROUP BY ALL)")
  + """ SELECT 'task' AS finding, CAST(name AS VARCHAR) AS name, round(v, 9) AS value FROM (SELECT * FROM a ORDER BY abs(v) DESC, name LIMIT 3)
  UNION ALL SELECT 'session', CAST(name AS VARCHAR), round(v, 9) FROM (SELECT * FROM b ORDER BY abs(v) DESC, name LIMIT 5)""")  # fmt: skip
def key_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest task and session effects (a top-k report)."""
    s = samples(spark, sf_dir)
    by_session = s.groupBy("session").agg((F.avg("x") - 50).alias("shift"))
    return _rounded(group.key_findings({"task": (group.task_shift(s, "task", "x"), "task", "shift", 3), "session": (by_session, "session", "shift", 5)}))


@query(_with(f"n AS (SELECT us // {DAY_US} AS bin, participant, event_type, count(*) AS n FROM samples GROUP BY ALL)", "s AS (SELECT *, n / sum(n) OVER (PARTITION BY bin, participant) AS s FROM n)")
  + " SELECT bin, event_type, round(sum(s), 9) AS attention FROM s GROUP BY ALL")
def shared_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(group.shared_attention(samples(spark, sf_dir), "us", "participant", "event_type", DAY_US))
