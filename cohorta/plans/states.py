"""Queries of biomarkers, quality rows, speaking, synchrony, zones and label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.functions import scalars as sc
from cohorta.operators import evaluate as ev
from cohorta.operators import states as st
from cohorta.operators import windows as win
from cohorta.plans.base import DAY_US, SAMPLES_SQL, day_sums, samples, table

QUERIES, ORACLE_SQL = {}, {}
HOUR_US = 3_600_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join([SAMPLES_SQL, *ctes])


#: A row of features of every user and task.
FEATURES_SQL = """feat AS (SELECT participant, session, seat, task, count(*) AS n, avg(x) AS eda, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS scr, max(x) AS rate, min(x) AS rmssd, avg(CASE WHEN event_type = 'view' THEN x END) AS pupil, stddev_pop(x) AS pupil_sd, avg(CASE WHEN valid THEN 0.0 ELSE 1.0 END) AS missing, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS valid_share FROM samples GROUP BY ALL)"""
FEATURES = ["eda", "scr", "rate", "rmssd", "pupil", "pupil_sd", "missing", "valid_share"]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, ok = F.col("x"), F.col("valid").cast("double")
    return samples(spark, sf_dir).groupBy("participant", "session", "seat", "task").agg(
        F.count("*").alias("n"), F.avg(x).alias("eda"), F.count_if(F.col("event_type") == "click").cast("double").alias("scr"), F.max(x).alias("rate"), F.min(x).alias("rmssd"),
        F.avg(F.when(F.col("event_type") == "view", x)).alias("pupil"), F.stddev_pop(x).alias("pupil_sd"), F.avg(1 - ok).alias("missing"), F.avg(ok).alias("valid_share"),
    )


def _z_sql(c: str) -> str:
    within = f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w ELSE 0 END END"
    first = f"max(CASE WHEN task = 0 THEN {c} END) OVER w"
    return f"CASE WHEN {first} IS NULL THEN {within} WHEN {c} IS NOT NULL THEN CASE WHEN stddev_samp({c}) OVER w > 0 THEN ({c} - {first}) / stddev_samp({c}) OVER w ELSE 0 END END AS z_{c}"


def _mean_sql(*parts: str) -> str:
    return f"(SELECT avg(v) FROM (VALUES {', '.join(f'({p})' for p in parts)}) t(v))"


def _mean_list(*parts: str) -> str:
    return f"list_avg(list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL))"


def _label(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'Unknown' WHEN {c} <= -1 THEN 'Low' WHEN {c} >= 1 THEN 'High' ELSE 'Moderate' END"


@query(_with(FEATURES_SQL, f"z AS (SELECT participant, task, {', '.join(map(_z_sql, FEATURES))} FROM feat WINDOW w AS (PARTITION BY participant))",
  f"""b AS (SELECT participant, task, {_mean_list('z_pupil', 'z_eda', '-z_rmssd')} AS load, {_mean_list('z_scr', 'z_rate', 'z_pupil_sd')} AS arousal, {_mean_list('z_valid_share', '-z_missing', '-z_pupil_sd')} AS attention,
  {_mean_list('-z_eda', '-z_rate', 'z_rmssd')} AS recovery, CASE WHEN task >= 1 THEN task * -z_pupil / 4 END AS fatigue, z_eda FROM z)""")
  + f""" SELECT participant, task, round(load, 6) AS load, round(arousal, 6) AS arousal, round(attention, 6) AS attention, round({_mean_list('arousal', 'z_eda')}, 6) AS decision, round(recovery, 6) AS recovery, round(fatigue, 6) AS fatigue,
  {_label('round(load, 6)')} AS load_label FROM b""")  # fmt: skip
def biomarkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of every user in every task, about the first task."""
    f = _features(spark, sf_dir)
    for c in FEATURES:
        f = f.withColumn(f"z_{c}", win.baseline_z(c, ["participant"], "task", "task", 0))
    b = st.biomarkers(f, {k: f"z_{c}" for k, c in zip(("eda", "scr", "rate", "rmssd", "pupil", "pupil_sd", "missing", "valid"), FEATURES)}, "task")
    r = b.select("participant", "task", *[F.round(c, 6).alias(c) for c in ("load", "arousal", "attention", "decision", "recovery", "fatigue")])
    return r.withColumn("load_label", sc.z_label(F.col("load")))


@query(_with(FEATURES_SQL, "s AS (SELECT avg(eda) AS a, stddev_pop(eda) AS b, avg(scr) AS c, stddev_pop(scr) AS d, avg(pupil) AS e, stddev_pop(pupil) AS f FROM feat)",
  "z AS (SELECT participant, task, (eda - a) / b AS x, -(scr - c) / d AS y, (pupil - e) / f AS w FROM feat, s)")
  + f" SELECT participant, task, CAST((x IS NOT NULL)::INT + (y IS NOT NULL)::INT + (w IS NOT NULL)::INT AS INTEGER) AS n, round(CASE WHEN (x IS NOT NULL)::INT + (y IS NOT NULL)::INT + (w IS NOT NULL)::INT >= 2 THEN {_mean_list('x', 'y', 'w')} END, 6) AS \"index\" FROM z")
def arousal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.signed_index(_features(spark, sf_dir), ["participant", "task"], {"eda": 1, "scr": -1, "pupil": 1}).withColumn("index", F.round("index", 6))


@query(_with("""p AS (SELECT participant, count(*) AS n, (max(us) - min(us)) / 8.64e10 AS duration_s, CASE WHEN count(*) > 3 THEN count(*) / 10.0 END AS hz, 100.0 * count(*) FILTER (WHERE event_type = 'view') / count(*) AS ppg_pct, 100.0 * count(*) FILTER (WHERE event_type <> 'click') / count(*) AS eda_pct,
  avg(x) AS device_rate, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS device_share, max(x) / 3 AS spectral_rate, stddev_pop(x) / 3 AS mismatch, median(x) AS rmssd, avg(CASE WHEN event_type <> 'click' THEN 1.0 ELSE 0.0 END) AS quality, min(x) + 30 AS temp, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS moving FROM samples GROUP BY ALL)""",
  "h AS (SELECT *, CASE WHEN device_share >= 0.5 AND device_rate BETWEEN 35 AND 220 THEN device_rate ELSE spectral_rate END AS heart_rate, CASE WHEN device_share >= 0.5 AND device_rate BETWEEN 35 AND 220 THEN 'device' ELSE 'spectral' END AS source, CASE WHEN quality >= 0.65 AND rmssd <= 300 THEN rmssd END AS hrv FROM p)")
  + """ SELECT participant, round(heart_rate, 6) AS heart_rate, source, round(hrv, 6) AS hrv, coalesce(nullif(concat_ws(';', CASE WHEN duration_s < 20 THEN 'short_duration' END, CASE WHEN hz IS NULL THEN 'sample_rate_unavailable' END, CASE WHEN hz NOT BETWEEN 2 AND 8 THEN 'sample_rate_unusual' END,
  CASE WHEN ppg_pct < 20 THEN 'ppg_low_coverage' END, CASE WHEN eda_pct < 20 THEN 'eda_low_coverage' END, CASE WHEN device_share < 0.5 THEN 'hr_low_coverage' END, CASE WHEN heart_rate NOT BETWEEN 35 AND 220 THEN 'hr_implausible' END, CASE WHEN mismatch > 20 THEN 'ppg_hr_mismatch' END,
  CASE WHEN NOT coalesce(hrv > 0, false) THEN 'hrv_unreliable' END, CASE WHEN temp NOT BETWEEN 20 AND 45 THEN 'temp_implausible' END, CASE WHEN moving > 0.2 THEN 'motion_contaminated' END, CASE WHEN hz IS NULL OR eda_pct < 20 THEN 'eda_phasic_detection_limited' END), ''), 'ok') AS qc FROM h""")  # fmt: skip
def physio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature row of every user with heart rate, its source, variability and all flags that apply."""
    x, share = F.col("x"), lambda t: F.avg(F.expr(t).cast("double"))
    p = samples(spark, sf_dir).groupBy("participant").agg(
        F.count("*").alias("n"), ((F.max("us") - F.min("us")) / 8.64e10).alias("duration_s"), F.when(F.count("*") > 3, F.count("*") / 10.0).alias("hz"), (100 * share("event_type = 'view'")).alias("ppg_pct"), (100 * share("event_type != 'click'")).alias("eda_pct"),
        F.avg(x).alias("device_rate"), share("valid").alias("device_share"), (F.max(x) / 3).alias("spectral_rate"), (F.stddev_pop(x) / 3).alias("mismatch"), F.percentile(x, F.lit(0.5)).alias("rmssd"), share("event_type != 'click'").alias("quality"),
        (F.min(x) + 30).alias("temp"), share("event_type = 'purchase'").alias("moving"),
    )
    none = F.lit(None).cast("double")
    for c in ("temp_pct", "accel_pct", "gyro_pct", "mag_pct", "temp_aux"):
        p = p.withColumn(c, none)
    return st.physio_row(p, 20.0, 20.0, (2.0, 8.0)).select("participant", F.round("heart_rate", 6).alias("heart_rate"), "source", F.round("hrv", 6).alias("hrv"), "qc")


#: Days as frames: of every session and seat the day's sum, and whether it is above half of the session's largest.
FRAMES_SQL = f"frames AS (SELECT session, seat, us // {DAY_US} AS frame, sum(x) AS rms FROM samples GROUP BY ALL), loud AS (SELECT *, rms > 60 AS speaking FROM frames)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = day_sums(spark, sf_dir).select("session", "seat", "frame", F.col("total").alias("rms"))
    return f.withColumn("speaking", F.col("rms") > 60)


@query(_with(FRAMES_SQL, "r AS (SELECT *, row_number() OVER (PARTITION BY session, seat ORDER BY frame) - row_number() OVER (PARTITION BY session, seat, speaking ORDER BY frame) AS g FROM loud)",
  "s AS (SELECT session, seat, g, min(frame) AS a, max(frame) AS z, count(*) AS n FROM r WHERE speaking GROUP BY ALL)", "p AS (SELECT *, (a - lag(z) OVER (PARTITION BY session, seat ORDER BY a) - 1) * 0.25 AS gap FROM s)",
  "t AS (SELECT session, seat, sum(n) * 0.25 AS speaking_s, count(*) AS segments, count(*) FILTER (WHERE gap >= 0.5) AS pauses FROM p GROUP BY ALL)", "c AS (SELECT session, seat, count(*) AS n FROM loud GROUP BY ALL)")
  + " SELECT session, seat, CAST(coalesce(speaking_s, 0) AS DOUBLE) AS speaking_s, round(coalesce(speaking_s, 0) / (n * 0.25), 9) AS speaking_share, coalesce(segments, 0) AS segments, coalesce(pauses, 0) AS pauses FROM c LEFT JOIN t USING (session, seat)")
def speaking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.speaking_metrics(_frames(spark, sf_dir), ["session"], "seat", "frame", "speaking", 0.25).withColumn("speaking_share", F.round("speaking_share", 9))


@query(_with(FRAMES_SQL, "r AS (SELECT session, frame, rms, row_number() OVER (PARTITION BY session, frame ORDER BY rms DESC) AS k FROM frames)",
  "f AS (SELECT session, frame, count(*) FILTER (WHERE rms > 20) AS n, max(CASE WHEN k = 1 THEN rms END) / greatest(max(CASE WHEN k = 2 THEN rms END), 20) AS ratio FROM r GROUP BY ALL)")
  + " SELECT session, round(coalesce(avg(CASE WHEN ratio >= 2 THEN 0.0 ELSE 1.0 END) FILTER (WHERE n >= 2), 0), 9) AS overlap FROM f GROUP BY ALL")
def overlap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.overlap_share(_frames(spark, sf_dir), ["session"], "frame", "rms", 20.0, 2.0).withColumn("overlap", F.round("overlap", 9))


@query(_with(FRAMES_SQL, "p AS (SELECT a.session, a.seat AS a, b.seat AS b, CASE WHEN stddev_pop(a.rms) < 1e-8 OR stddev_pop(b.rms) < 1e-8 THEN 0 ELSE covar_pop(a.rms, b.rms) / (stddev_pop(a.rms) * stddev_pop(b.rms)) END AS r FROM frames a JOIN frames b ON a.session = b.session AND a.frame = b.frame AND a.seat < b.seat GROUP BY ALL)")
  + " SELECT session, count(*) AS pairs, round(avg(r), 7) AS mean, round(stddev_pop(r), 7) AS sd, round(max(r), 7) AS largest FROM p GROUP BY ALL")
def synchrony(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.synchrony(_frames(spark, sf_dir), ["session"], "frame", "seat", "rms")
    return s.select("session", "pairs", *[F.round(c, 7).alias(c) for c in ("mean", "sd", "largest")])


_EVENTS_SQL = """long AS (SELECT participant, event_id, 'high' AS event, x > 60 AS on_ FROM samples UNION ALL SELECT participant, event_id, 'lost', NOT valid FROM samples),
isl AS (SELECT *, row_number() OVER (PARTITION BY participant, event ORDER BY event_id) - row_number() OVER (PARTITION BY participant, event, on_ ORDER BY event_id) AS g FROM long),
ev AS (SELECT participant, event, count(*) AS n, min(event_id) AS start, max(event_id) AS "end" FROM isl WHERE on_ GROUP BY participant, event, g)"""


def _gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("participant", "event_id", (F.col("x") > 60).alias("high"), (~F.col("valid")).alias("lost"))
    return st.flag_events(s, ["participant"], "event_id", ["high", "lost"])


@query(_with(_EVENTS_SQL) + ' SELECT participant, event, n, start, "end" FROM ev')
def gesture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of every sample as events with a start and an end."""
    return _gestures(spark, sf_dir)


@query(_with(_EVENTS_SQL) + " SELECT participant, event, count(*) AS events, CAST(sum(n) AS BIGINT) AS frames FROM ev GROUP BY GROUPING SETS ((participant), (event), ())")
def gesture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.event_summary(_gestures(spark, sf_dir), "participant")


@query("""WITH s AS (SELECT c_custkey, avg(c_acctbal) AS balance, CAST(min(c_nationkey) AS DOUBLE) AS nation, avg(o_totalprice) AS price, CAST(count(*) AS DOUBLE) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
l AS (SELECT t AS trait, r AS rating, CASE t WHEN 'balance' THEN balance ELSE nation END AS x, CASE r WHEN 'price' THEN price ELSE orders END AS y FROM s, unnest(['balance', 'nation']) a(t), unnest(['price', 'orders']) b(r)),
k AS (SELECT trait, rating, rank() OVER (PARTITION BY trait, rating ORDER BY x) + (count(*) OVER (PARTITION BY trait, rating, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY trait, rating ORDER BY y) + (count(*) OVER (PARTITION BY trait, rating, y) - 1) / 2 AS ry FROM l)
SELECT trait, rating, count(*) AS n, round(corr(rx, ry), 8) AS r FROM k GROUP BY ALL""")
def trait_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balance and nation as traits, their orders as ratings."""
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    s = j.groupBy("c_custkey").agg(F.avg("c_acctbal").alias("balance"), F.min("c_nationkey").cast("double").alias("nation"), F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))
    return st.rank_correlations(s, ["balance", "nation"], ["price", "orders"]).withColumn("r", F.round("r", 8))


@query(_with() + " SELECT participant, " + ", ".join(f"round(coalesce(avg(CASE WHEN task = {t} THEN x END), 0), 10) AS t{t}" for t in range(5)) + " FROM samples GROUP BY ALL")
def subject_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = st.subject_vectors(samples(spark, sf_dir), "participant", "task", "x", list(range(5)))
    return v.select("participant", *[F.round(F.get("vector", t), 10).alias(f"t{t}") for t in range(5)])


@query(_with("s AS (SELECT seat, task, avg(x) AS score FROM samples GROUP BY ALL)", "t AS (SELECT seat, avg(score) AS mean, " + ", ".join(f"avg(CASE WHEN task = {k} THEN score END) AS fold_{k}" for k in range(5)) + " FROM s GROUP BY ALL)")
  + " SELECT seat, " + ", ".join(f"round(fold_{k}, 10) AS fold_{k}" for k in range(5)) + ", round(mean, 10) AS mean, round(mean - (SELECT mean FROM t WHERE seat = 0), 10) AS delta FROM t")
def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats as variants, tasks as folds."""
    s = samples(spark, sf_dir).groupBy("seat", "task").agg(F.avg("x").alias("score"))
    r = st.results_table(s, "seat", "task", "score", list(range(5)), 0)
    return r.select("seat", *[F.round(c, 10).alias(c) for c in r.columns if c != "seat"])


@query("""WITH p AS (SELECT o_orderkey, (o_orderkey % 100) / 10.0 AS x, (o_custkey % 100) / 10.0 AS y, o_orderkey % 5 AS m, o_custkey % 7 AS e FROM orders)
SELECT o_orderkey, CASE WHEN (x - 5) * (x - 5) + (y - 5) * (y - 5) <= 4 THEN 'centre' WHEN x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 5 THEN 'left' WHEN (x - 7) * (x - 7) + (y - 2) * (y - 2) <= 9 THEN 'right' ELSE 'other' END AS zone, m >= 2 AND e <= 4.5 AS good FROM p""")
def gaze_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the desk in overlapping zones, and whether their frame is good."""
    zones = [("right", 5, "circle", 7.0, 2.0, 3.0), ("left", 5, "rect", 6.0, 5.0, 2.0, 1.0), ("centre", 1, "circle", 5.0, 5.0, 2.0)]
    p = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100) / 10).alias("x"), ((F.col("o_custkey") % 100) / 10).alias("y"), (F.col("o_orderkey") % 5).alias("m"), (F.col("o_custkey") % 7).alias("e"))
    return p.select("o_orderkey", st.zone_of(F.col("x"), F.col("y"), zones).alias("zone"), st.good_gaze(F.col("m"), F.col("e"), 2, 4.5).alias("good"))


@query(_with("m AS (SELECT participant, min(us) AS a, min(x) AS lo, max(x) AS hi FROM samples GROUP BY ALL)") + " SELECT event_id, us - a AS us, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END, 9) AS scaled FROM samples JOIN m USING (participant)")
def unit_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples from 0 to 1 within their user, at times since the user's first."""
    s = st.rebased(samples(spark, sf_dir), ["participant"], "us")
    return st.unit_scaled(s, ["participant"], "x").select("event_id", "us", F.round("scaled", 9).alias("scaled"))


@query(_with() + " SELECT array_to_string(list_sort(list(DISTINCT k)), '|') AS keys, count(*) FILTER (WHERE k = 'mean') AS n FROM (SELECT event_type || '_n' AS k FROM samples UNION ALL SELECT 'mean' FROM samples)")
def feature_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of two maps of features, in order, and how many rows keep the first map when the second is emptied."""
    s = samples(spark, sf_dir).select(F.create_map(F.lit("mean"), F.col("x")).alias("a"), F.create_map(F.concat("event_type", F.lit("_n")), F.lit(1.0)).alias("b"))
    left = st.without_modality(s, "b").agg(F.count_if((F.size("b") == 0) & (F.size("a") == 1)).alias("n"))
    return st.key_order(s, ["a", "b"]).crossJoin(left).select(F.array_join("keys", "|").alias("keys"), "n")


@query(_with() + " SELECT session, seat, count(*) AS reports, array_to_string(list(event_id || ':' || event_type ORDER BY us, event_id), ' ') AS series FROM samples WHERE event_type IN ('signup', 'purchase') GROUP BY ALL")
def report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = st.report_index(samples(spark, sf_dir).where("event_type in ('signup', 'purchase')"), ["session", "seat"], "us", ["event_id", "event_type"])
    return r.withColumn("series", F.array_join(F.transform("series", lambda e: F.concat(e["event_id"].cast("string"), F.lit(":"), e["event_type"])), " "))


@query(_with(f"p AS (SELECT x, lead(x) OVER w AS y, (lead(us) OVER w - us) / {HOUR_US}.0 AS lag FROM samples WINDOW w AS (PARTITION BY participant ORDER BY us))", "q AS (SELECT * FROM p WHERE lag > 5 AND lag < 300)",
  "b AS (SELECT round_even(lag / 10, 0) * 10 AS bin, count(*) AS n, corr(x, y) AS r FROM q WHERE abs(lag - round_even(lag / 10, 0) * 10) < 5 GROUP BY 1 HAVING count(*) >= 2)",
  "f AS (SELECT count(*) AS bins, greatest(-sum(bin * ln(r)) / sum(bin * bin), 0.01) AS rate FROM b WHERE r > 1e-6 AND r < 1)", "s AS (SELECT count(*) AS pairs, (avg(x) + avg(y)) / 2 AS m, (avg(x * x) + avg(y * y)) / 2 AS sq FROM q)",
  "o AS (SELECT *, pairs >= 5 AND bins >= 2 AND rate BETWEEN 0.03 / 5 AND 0.03 * 5 AS ok FROM s, f)")
  + " SELECT pairs, round(CASE WHEN ok THEN rate ELSE 0.03 END, 7) AS rate, round(CASE WHEN ok THEN sq - m * m ELSE 4 END, 5) AS variance, round(CASE WHEN ok THEN m ELSE 5 END, 7) AS mean FROM o")
def process_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fast users' values forget themselves, in hours."""
    s = samples(spark, sf_dir).withColumn("h", F.col("us") / HOUR_US)
    p = st.process_parameters(s, ["participant"], "h", "x", (0.03, 4.0, 5.0))
    return p.select("pairs", F.round("rate", 7).alias("rate"), F.round("variance", 5).alias("variance"), F.round("mean", 7).alias("mean"))


@query()
def weight_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user's other ratings predict the class of one, by seat, and the floor that follows."""
    s = samples(spark, sf_dir).withColumn("d", F.col("us") / DAY_US)
    post = st.left_out_posterior(s.where("event_type in ('signup', 'view')"), ["participant", "seat"], "d", "x", 50.0, 0.5, 30.0, 10.0)
    return st.left_out_accuracy(post, ["seat"], 20.0, 60.0)


@query(_with(f"w AS (SELECT participant, us // {DAY_US} AS day, avg(x) AS m FROM samples WHERE task = 0 GROUP BY ALL)") + " SELECT participant, round(avg(m), 7) AS baseline, count(m) AS windows FROM w GROUP BY ALL")
def rest_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = st.rest_baseline(samples(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY_US)), ["participant"], "day", "task", "x", 0)
    return b.withColumn("baseline", F.round("baseline", 7))


@query(_with("t AS (SELECT seat, 0.2 + 0.2 * seat AS trust FROM (SELECT DISTINCT seat FROM samples))", "c AS (SELECT event_id, seat, (event_id % 10) / 10.0 AS share, (event_id % 7) / 6.0 AS weight, x FROM samples)")
  + " SELECT event_id, round(trust * weight, 9) AS trusted_weight FROM c JOIN t USING (seat) WHERE trust * weight >= 0.3 AND share >= 0.5")
def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("event_id", "seat", ((F.col("event_id") % 10) / 10).alias("share"), ((F.col("event_id") % 7) / 6).alias("weight"))
    trust = s.select("seat").distinct().withColumn("trust", 0.2 + 0.2 * F.col("seat"))
    return st.trusted(s, trust, ["seat"], "share", "weight", 0.3).select("event_id", F.round("trusted_weight", 9).alias("trusted_weight"))


@query(_with("b AS (SELECT event_id, x / 2 AS v FROM samples WHERE event_type = 'view')") + " SELECT event_id, coalesce(v, x) AS x, CAST(CASE WHEN v IS NULL THEN 0 ELSE CASE task WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 WHEN 2 THEN 0.9 ELSE 0 END END AS DOUBLE) AS weight FROM samples LEFT JOIN b USING (event_id)")
def label_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("event_id", "event_type", "task", "x").withColumn("weight", F.lit(1.0))
    better = s.where("event_type = 'view'").select("event_id", (F.col("x") / 2).alias("x"))
    return st.overridden(s, better, ["event_id"], "x", "weight", "task", {0: 0.5, 1: 0.7, 2: 0.9}).select("event_id", "x", "weight")


@query(_with(FEATURES_SQL, "s AS (SELECT avg(eda) AS a, stddev_pop(eda) AS b, avg(rate) AS c, stddev_pop(rate) AS d FROM feat WHERE task < 3)") + " SELECT participant, task, round((eda - a) / b, 6) AS eda, round((rate - c) / d, 6) AS rate FROM feat, s")
def train_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features scaled by the means and spreads of the first three tasks."""
    f = _features(spark, sf_dir).withColumn("role", F.when(F.col("task") < 3, "train").otherwise("test"))
    return st.train_scaled(f, "role", ["eda", "rate"]).select("participant", "task", F.round("eda", 6).alias("eda"), F.round("rate", 6).alias("rate"))


@query(_with("f AS (SELECT seat AS fold, CASE WHEN x <= 20 THEN 0 WHEN x <= 60 THEN 1 ELSE 2 END AS y, CASE WHEN task = 4 THEN 2 ELSE task % 3 END AS p FROM samples)", "c AS (SELECT k, sum((y = k AND p = k)::INT) AS tp, sum((y = k)::INT) + sum((p = k)::INT) AS total FROM f, range(3) r(k) GROUP BY ALL)")
  + " SELECT (SELECT count(*) FROM f) AS n, round((SELECT avg((y = p)::INT) FROM f), 9) AS accuracy, round(avg(CASE WHEN total > 0 THEN 2 * tp / total ELSE 0 END), 9) AS macro_f1 FROM c")
def pooled_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions of all folds scored once."""
    from cohorta.operators.context import union_tables

    s = samples(spark, sf_dir).select("seat", sc.rating_class(F.col("x"), 20, 60).alias("y"), F.when(F.col("task") == 4, 2).otherwise(F.col("task") % 3).alias("p"))
    pool = union_tables([s.where(F.col("seat") == k) for k in range(4)])
    return ev.classification(pool, [], "y", "p", 3).select("n", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))
