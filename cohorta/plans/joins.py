"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import joins as j
from cohorta.operators import windows as win
from cohorta.plans.base import DAY_US, SAMPLES_SQL, micros, samples, table
from cohorta.plans.windows import TASKS_SQL, _tasks

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


@query(_with(TASKS_SQL) + " SELECT s.event_id, s.session, t.task, us - start_us AS onset_us FROM samples s JOIN tasks t ON s.session = t.session AND us >= start_us AND us < end_us")
def sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with each task window of its group that holds it, times from the window's start."""
    s = samples(spark, sf_dir)
    hit = j.range_join(s.select("event_id", "session", "us"), _tasks(s), ["session"], "us", "start_us", "end_us", 5 * DAY_US)
    return hit.select("event_id", "session", "task", (F.col("us") - F.col("start_us")).alias("onset_us"))


@query(_with() + f""" SELECT r.event_id, count(*) AS n, round(avg(s.x), 9) AS mean FROM samples r JOIN samples s ON s.participant = r.participant AND s.us BETWEEN r.us - {3 * DAY_US} AND r.us
  WHERE r.event_type = 'purchase' GROUP BY r.event_id HAVING count(*) >= 5""")  # fmt: skip
def trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase, the user's samples of the three days up to it, both ends included."""
    s = samples(spark, sf_dir)
    asked = s.where("event_type = 'purchase'").select("participant", F.col("event_id"), (F.col("us") - 3 * DAY_US).alias("a"), F.col("us").alias("z"))
    hit = j.range_join(s.select("participant", "us", "x"), asked, ["participant"], "us", "a", "z", 3 * DAY_US, True)
    return hit.groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.avg("x"), 9).alias("mean")).where("n >= 5")


NEAREST_SQL = """p AS (SELECT participant, us, x FROM samples WHERE event_type = 'view'), c AS (SELECT event_id, participant, us FROM samples WHERE event_type = 'click'),
  b AS (SELECT c.*, p.us AS b_us, p.x AS b_x FROM c ASOF LEFT JOIN p ON c.participant = p.participant AND c.us >= p.us),
  a AS (SELECT b.*, p.us AS a_us, p.x AS a_x FROM b ASOF LEFT JOIN p ON b.participant = p.participant AND b.us <= p.us)"""


@query(_with(NEAREST_SQL) + f""" SELECT event_id, CASE WHEN abs(n_us - us) <= {DAY_US} THEN n_us END AS near_at, CASE WHEN abs(n_us - us) <= {DAY_US} THEN n_x END AS near_value
  FROM (SELECT *, CASE WHEN a_us IS NULL OR us - b_us <= a_us - us THEN b_us ELSE a_us END AS n_us, CASE WHEN a_us IS NULL OR us - b_us <= a_us - us THEN b_x ELSE a_x END AS n_x FROM a)""")  # fmt: skip
def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click the user's view nearest in time, a day away at most."""
    s = samples(spark, sf_dir)
    clicks, views = s.where("event_type = 'click'").select("event_id", "participant", "us"), s.where("event_type = 'view'").select("participant", "us", "x")
    return j.nearest(clicks, views, ["participant"], "us", "x", DAY_US).select("event_id", "near_at", "near_value")


@query(_with(f"""e AS (SELECT participant, min(us) AS a, max(us) AS z FROM samples GROUP BY ALL),
  g AS (SELECT participant, a + k * {2 * DAY_US} AS us FROM e, unnest(range(0, (z - a) // {2 * DAY_US} + 1)) u(k)), c AS (SELECT participant, us, x FROM samples),
  b AS (SELECT g.*, c.us AS b_us, c.x AS b_x FROM g ASOF LEFT JOIN c ON g.participant = c.participant AND g.us >= c.us),
  f AS (SELECT b.*, c.us AS a_us, c.x AS a_x FROM b ASOF LEFT JOIN c ON b.participant = c.participant AND b.us <= c.us),
  n AS (SELECT participant, us, CASE WHEN a_us IS NULL OR us - b_us <= a_us - us THEN b_us ELSE a_us END AS n_us, CASE WHEN a_us IS NULL OR us - b_us <= a_us - us THEN b_x ELSE a_x END AS n_x FROM f)""")
  + f" SELECT participant, us, CASE WHEN abs(n_us - us) <= {DAY_US // 4} THEN n_x END AS value, CAST(abs(n_us - us) > {DAY_US // 4} AS INTEGER) AS is_missing FROM n")
def resampled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user on a two-day grid: the nearest sample within six hours, or missing."""
    g = j.resampled_grid(samples(spark, sf_dir), ["participant"], "us", "x", 2 * DAY_US, DAY_US // 4)
    return g.select("participant", "us", F.col("near_value").alias("value"), "is_missing")


@query(_with("""seg AS (SELECT participant, us, 1 + seat / 1000.0 AS scale, CAST(event_id AS DOUBLE) AS "offset" FROM samples WHERE event_type = 'signup'),
  c AS (SELECT event_id, participant, us FROM samples WHERE event_type = 'click'), b AS (SELECT c.*, s.scale, s."offset" FROM c ASOF LEFT JOIN seg s ON c.participant = s.participant AND c.us >= s.us),
  f AS (SELECT participant, arg_min(scale, us) AS scale, arg_min("offset", us) AS "offset" FROM seg GROUP BY ALL)""")
  + """ SELECT event_id, round(coalesce(b.scale, f.scale) * (us - 1704067200000000) / 1e6 + coalesce(b."offset", f."offset"), 4) AS mapped FROM b LEFT JOIN f USING (participant)""")
def piecewise_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks on the clock of the user's last signup before them (else the first one)."""
    s = samples(spark, sf_dir)
    segments = s.where("event_type = 'signup'").select("participant", "us", (1 + F.col("seat") / 1000).alias("scale"), F.col("event_id").cast("double").alias("offset"))
    clicks = s.where("event_type = 'click'").select("event_id", "participant", "us")
    own = j.backward(clicks, segments, ["participant"], "us", ["scale", "offset"])
    return own.select("event_id", F.round(F.col("scale") * (F.col("us") - 1704067200000000) / 1e6 + F.col("offset"), 4).alias("mapped"))


SPEECH_SQL = f"""w AS (SELECT participant, b AS k, 1704067200000000 + b * {3 * DAY_US} AS w_start, 1704067200000000 + (b + 1) * {3 * DAY_US} AS w_end FROM (SELECT DISTINCT participant FROM samples), unnest(range(0, 10)) u(b)),
  u AS (SELECT participant, us AS onset, CAST(floor(x * 1000000000) AS BIGINT) AS duration, event_id % 7 AS words FROM samples WHERE event_type = 'view'),
  h AS (SELECT w.participant, k, least(duration, greatest(w_end - onset, 0)) AS d, words FROM w JOIN u ON u.participant = w.participant AND onset < w_end AND onset + duration > w_start)"""


@query(_with(SPEECH_SQL, "a AS (SELECT participant, k, count(*) AS n, sum(d) AS speech, sum(words) AS words, max(d) AS longest FROM h GROUP BY ALL)")
  + """ SELECT participant, k, coalesce(n, 0) AS n_utterances, CAST(coalesce(speech, 0) AS BIGINT) AS speech, CAST(coalesce(words, 0) AS BIGINT) AS words, coalesce(longest, 0) AS longest, round(coalesce(speech, 0) / (w_end - w_start), 9) AS share
  FROM w LEFT JOIN a USING (participant, k) WHERE participant IN (SELECT participant FROM u)""")  # fmt: skip
def speech_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as utterances, over three-day windows of each user."""
    s = samples(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("k")
    w = s.select("participant").distinct().select("participant", k).withColumn("w_start", 1704067200000000 + F.col("k") * 3 * DAY_US).withColumn("w_end", F.col("w_start") + 3 * DAY_US)
    u = s.where("event_type = 'view'").select("participant", F.col("us").alias("onset"), F.floor(F.col("x") * 1000000000).alias("duration"), (F.col("event_id") % 7).alias("words"))
    out = j.speech_features(w, u, ["participant"], 3 * DAY_US).where("n_utterances is not null")
    return out.select("participant", "k", "n_utterances", "speech", "words", "longest", F.round("share", 9).alias("share"))


@query("""WITH have AS (SELECT c_nationkey AS n_nationkey, c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL)
SELECT n.n_nationkey, s.segment, coalesce(h.n, 0) AS n, h.balance, coalesce(CASE WHEN h.n > 0 THEN 'ok' END, 'missing_rows') AS qc
FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer) s LEFT JOIN have h USING (n_nationkey, segment)""")
def expected_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by market segments, with the customers found or the defaults."""
    c = table(spark, sf_dir, "customer")
    have = c.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")).withColumn("qc", F.lit("ok"))
    dims = [table(spark, sf_dir, "nation").select("n_nationkey"), c.select(F.col("c_mktsegment").alias("segment")).distinct()]
    return j.expected_grid(dims, have, ["n_nationkey", "segment"], {"n": 0, "qc": "missing_rows"})


BAND_SQL = f"""SELECT a.session, a.seat, a.us, b.seat AS r_seat, b.us AS r_us, b.x AS r_x FROM samples a JOIN samples b ON a.session = b.session AND a.seat <> b.seat AND abs(a.us - b.us) <= {DAY_US // 4}
  WHERE a.event_type = 'signup' AND b.event_type = 'signup'"""


@query(_with(f"p AS ({BAND_SQL})") + " SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY session, seat, us, r_seat ORDER BY r_us) = 1")
def first_report_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each signup, every other seat's first signup within six hours of it."""
    r = samples(spark, sf_dir).where("event_type = 'signup'").select("session", "seat", "us", "x")
    return j.first_report_near(r, ["session"], "seat", "us", DAY_US // 4).drop("x")


@query(_with(f"""r AS (SELECT session, seat, us, x FROM samples WHERE event_type = 'signup'), p AS ({BAND_SQL}),
  f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session, seat ORDER BY us) <= 3)""")
  + """ SELECT * FROM p UNION ALL SELECT r.session, r.seat, r.us, f.seat, f.us, f.x FROM r JOIN f ON r.session = f.session AND r.seat <> f.seat
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.session = r.session AND p.seat = r.seat AND p.us = r.us)""")  # fmt: skip
def near_or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = samples(spark, sf_dir).where("event_type = 'signup'").select("session", "seat", "us", "x")
    return j.near_or_first(r, r, ["session"], "seat", "us", DAY_US // 4).drop("x")


@query(_with("m AS (SELECT session, task, participant, avg(x) AS x, count(*) AS n FROM samples GROUP BY ALL)")
  + " SELECT a.session, a.task, a.participant AS a, b.participant AS b, round(a.x - b.x, 9) AS difference, a.n + b.n AS n FROM m a JOIN m b ON a.session = b.session AND a.task = b.task AND a.participant < b.participant")
def dyads(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = samples(spark, sf_dir).groupBy("session", "task", "participant").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return j.dyads(m, ["session", "task"], "participant", ["x", "n"]).select("session", "task", "a", "b", F.round(F.col("x_a") - F.col("x_b"), 9).alias("difference"), (F.col("n_a") + F.col("n_b")).alias("n"))


@query(_with("o AS (SELECT session, task, seat, us, row_number() OVER (PARTITION BY session, task, seat ORDER BY us) AS ordinal FROM samples)",
  f"""h AS (SELECT a.session, a.task, a.seat, a.us, b.seat AS partner, b.us AS partner_at, CASE b.ordinal - a.ordinal WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS preference FROM o a JOIN o b ON a.session = b.session AND a.task = b.task AND a.seat <> b.seat AND abs(a.ordinal - b.ordinal) <= 1 AND abs(a.us - b.us) <= {DAY_US})""")
  + " SELECT session, task, seat, us, partner, partner_at FROM h QUALIFY row_number() OVER (PARTITION BY session, task, seat, us, partner ORDER BY preference) = 1")
def partner_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = j.partner_windows(samples(spark, sf_dir), ["session", "task"], "seat", "us", DAY_US)
    return p.select("session", "task", "seat", "us", "partner", "partner_at")


@query(f"""WITH r AS (SELECT o_orderkey, epoch_us(o_orderdate) AS a0, epoch_us(o_orderdate) + (o_orderkey % 90 + 1) * {DAY_US} AS a1, o_custkey FROM orders)
SELECT x.o_orderkey AS a, y.o_orderkey AS b, (least(x.a1, y.a1) - greatest(x.a0, y.a0)) // {DAY_US} AS days FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a0 < y.a1 AND x.a1 > y.a0""")
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders whose processing times overlap, and by how many days."""
    r = table(spark, sf_dir, "orders").select("o_orderkey", micros("o_orderdate").alias("a0"), "o_custkey").withColumn("a1", F.col("a0") + (F.col("o_orderkey") % 90 + 1) * DAY_US)
    x, y = r.toDF("a", "a0", "c", "a1"), r.toDF("b", "b0", "c", "b1")
    hit = j.overlap_join(x, y, ["c"], ("a0", "a1"), ("b0", "b1"), 90 * DAY_US).where("a < b")
    return hit.select("a", "b", F.floor(j.overlap_length("a0", "a1", "b0", "b1") / DAY_US).alias("days"))


@query("""WITH r AS (SELECT o_orderkey, CAST((o_orderkey * 7919) % 100000 AS BIGINT) AS s, CAST(o_orderkey % 5000 + 100 AS BIGINT) AS d, CAST(30000 AS BIGINT) AS a, CAST(60000 AS BIGINT) AS z FROM orders),
t AS (SELECT o_orderkey, h, greatest(least(s + h * 3600 + d, z) - greatest(s + h * 3600, a), 0) AS o FROM r, unnest(range(-14, 15)) u(h))
SELECT o_orderkey, CAST(CASE WHEN max(o) > 0 THEN arg_max(h, (o, -abs(h), h)) ELSE 0 END AS INTEGER) AS shift_h FROM t GROUP BY o_orderkey""")
def whole_hour_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select("o_orderkey", (k * 7919 % 100000).alias("s"), (k % 5000 + 100).alias("d"), F.lit(30000).alias("a"), F.lit(60000).alias("z"))
    return j.whole_hour_repair(r, "s", "d", "a", "z").select("o_orderkey", "shift_h")


@query("""WITH l AS (SELECT DISTINCT p_name AS a FROM part), r AS (SELECT DISTINCT p_name || 's' AS b FROM part WHERE p_partkey % 3 = 0),
h AS (SELECT a, b, 1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b), 1) AS similarity FROM l JOIN r ON lower(a[1]) = lower(b[1]))
SELECT a, b, round(similarity, 9) AS similarity FROM h WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) = 1""")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against a third of the respelled ones, by first letter as its SQL; see ``fuzzy_match_whole``."""
    p = table(spark, sf_dir, "part")
    left, right = p.select(F.col("p_name").alias("a")).distinct(), p.where("p_partkey % 3 = 0").select(F.concat("p_name", F.lit("s")).alias("b")).distinct()
    return j.fuzzy_match(left, right, "a", "b", same_first=True).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query()
def fuzzy_match_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against all respelled ones, whatever their first letters. All pairs would be slow in SQL."""
    p = table(spark, sf_dir, "part")
    left, right = p.select(F.col("p_name").alias("a")).distinct(), p.select(F.concat("p_name", F.lit("s")).alias("b")).distinct()
    return j.fuzzy_match(left, right, "a", "b").select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(_with(TASKS_SQL, "w AS (SELECT session, count(*) AS tasks, min(start_us) AS first_us FROM tasks GROUP BY ALL)", "s AS (SELECT session, count(*) AS n FROM samples GROUP BY ALL)")
  + " SELECT s.session, n, coalesce(tasks, 0) AS tasks, first_us, CASE WHEN tasks IS NULL THEN 'no_tasks' WHEN tasks < 5 THEN 'few_tasks' ELSE '' END AS notes FROM s LEFT JOIN w USING (session)")
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    w = _tasks(s).groupBy("session").agg(F.count("*").alias("tasks"), F.min("start_us").alias("first_us"))
    notes = F.concat_ws(";", F.when(F.col("tasks").isNull(), "no_tasks"), F.when(F.col("tasks") < 5, "few_tasks"))
    return s.groupBy("session").agg(F.count("*").alias("n")).join(w, "session", "left").select("session", "n", F.coalesce("tasks", F.lit(0).cast("long")).alias("tasks"), "first_us", notes.alias("notes"))
