"""Queries of the context operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.functions import scalars as sc
from cohorta.operators import context as ctx
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


@query(_with() + """, rows AS (
  SELECT event_id, item, value FROM samples, unnest([{'item': 'valence', 'value': CAST(event_id % 9 + 1 AS VARCHAR)}, {'item': 'arousal', 'value': CAST(event_id % 7 + 1 AS VARCHAR)}]) u(e), LATERAL (SELECT e.item AS item, e.value AS value) WHERE event_type = 'signup'
  UNION ALL SELECT event_id, 'q1', 'seat ' || seat FROM samples WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'q2', CAST(event_id % 5 AS VARCHAR) FROM samples WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, 'probe_name', 'p' || (event_id % 3) FROM samples WHERE event_type = 'view' UNION ALL SELECT event_id, 'load', CAST(event_id % 4 AS VARCHAR) FROM samples WHERE event_type = 'view'
  UNION ALL SELECT event_id, 'k', CAST(json_extract_string(props, '$.k') AS VARCHAR) FROM samples WHERE event_type NOT IN ('signup', 'purchase', 'view') AND json_extract_string(props, '$.k') IS NOT NULL)
SELECT event_id, item, value FROM rows""")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all kinds, written as JSON and taken apart again."""
    s = samples(spark, sf_dir)
    n = lambda k: (F.col("event_id") % k).cast("string")
    payload = F.when(F.col("event_type") == "signup", F.concat(F.lit('{"type":"VAD","valence":'), (F.col("event_id") % 9 + 1).cast("string"), F.lit(',"arousal":'), (F.col("event_id") % 7 + 1).cast("string"), F.lit(',"dominance":null}')))
    payload = payload.when(F.col("event_type") == "purchase", F.concat(F.lit('{"type":"postblock","responses":{"q2":'), n(5), F.lit(',"q1":"seat '), F.col("seat").cast("string"), F.lit('"}}')))
    payload = payload.when(F.col("event_type") == "view", F.concat(F.lit('{"type":"probe","probe_name":"p'), n(3), F.lit('","load":'), n(4), F.lit("}"))).otherwise(F.col("props"))
    return ctx.answer_rows(s.withColumn("payload", payload), ["event_id"], "payload")


@query(_with("w AS (SELECT *, CASE WHEN valid THEN us END AS wall FROM samples)", "f AS (SELECT session, min(wall) AS t0 FROM w GROUP BY ALL)")
  + " SELECT event_id, wall - t0 AS onset, 'task=' || task || ';stream=' || event_type || ';participant=' || seat AS description FROM w JOIN f USING (session) WHERE wall >= 0")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("wall", F.when(F.col("valid"), F.col("us")))
    return ctx.session_events(s, "session", "wall", {"task": "task", "stream": "event_type", "participant": "seat"}).select("event_id", "onset", "description")


@query(_with("p AS (SELECT session, seat, event_type AS signal, 0 AS part, us, 'stream' AS source FROM samples WHERE valid UNION ALL SELECT session, seat, event_type, 1, us, 'answer' FROM samples)")
  + " SELECT session, signal, CAST(arg_min(seat, (part, us, seat)) AS INTEGER) AS seat, arg_min(source, (part, us, seat)) AS source FROM p GROUP BY ALL")
def signal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which seat first showed a signal of a session: valid streams first, then any row."""
    s = samples(spark, sf_dir).withColumn("signal", F.col("event_type"))
    part = lambda d, n: d.select("session", "signal", "us", "seat", F.lit(n).alias("source"))
    return ctx.first_of([part(s.where("valid"), "stream"), part(s, "answer")], ["session", "signal"], "us").select("session", "signal", "seat", "source")


@query(_with("p AS (SELECT session, task, seat, round(avg(x), 9) AS value, count(*) AS n FROM samples WHERE event_type = 'click' GROUP BY ALL)", "q AS (SELECT session, task, seat, round(avg(x), 9) AS value, max(us) AS last_us FROM samples WHERE event_type = 'view' GROUP BY ALL)")
  + " SELECT session, task, seat, p.value AS value_physio, n, q.value AS value_pupil, last_us FROM p FULL JOIN q USING (session, task, seat)")
def modality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, keys = samples(spark, sf_dir), ["session", "task", "seat"]
    p = s.where("event_type = 'click'").groupBy(*keys).agg(F.round(F.avg("x"), 9).alias("value"), F.count("*").alias("n"))
    q = s.where("event_type = 'view'").groupBy(*keys).agg(F.round(F.avg("x"), 9).alias("value"), F.max("us").alias("last_us"))
    return ctx.outer_join(p, q, keys, ("_physio", "_pupil"))


@query("SELECT o_orderkey, o_totalprice, arg_max(l_quantity, (l_linenumber, l_quantity)) AS l_quantity, max(l_linenumber) AS l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def frame_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames, with the last of their lines as the stream's record of it."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return ctx.last_record_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"], "l_linenumber")


@query(_with("f AS (SELECT session, seat, round(avg(x), 9) AS mean FROM samples GROUP BY ALL)", "s AS (SELECT session, count(*) AS events FROM samples WHERE event_type = 'error' GROUP BY ALL)", "p AS (SELECT session, seat, min(us) AS first_us FROM samples WHERE event_type = 'signup' GROUP BY ALL)")
  + " SELECT session, seat, mean, events, first_us FROM f LEFT JOIN s USING (session) LEFT JOIN p USING (session, seat)")
def feature_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the notes of their session and of their participant."""
    s = samples(spark, sf_dir)
    f = s.groupBy("session", "seat").agg(F.round(F.avg("x"), 9).alias("mean"))
    notes = s.where("event_type = 'error'").groupBy("session").agg(F.count("*").alias("events"))
    own = s.where("event_type = 'signup'").groupBy("session", "seat").agg(F.min("us").alias("first_us"))
    return ctx.with_context(f, [(notes, ["session"]), (own, ["session", "seat"])])


@query("""WITH n AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 'gaze' || (c_nationkey % 6) || '_stream' WHEN 1 THEN 'Tablet ' || (c_nationkey % 6) WHEN 2 THEN 'ffmpeg_progress_acq--' || c_nationkey || '..x' ELSE 'AUX-P' || (c_nationkey % 6) || '-DPA_mic' || c_nationkey END AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'Markers' WHEN 1 THEN 'clock' ELSE 'gaze' END AS kind FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_nationkey % 6 BETWEEN 1 AND 4 THEN 'P' || (c_nationkey % 6) END AS routed,
  CASE WHEN c_custkey % 4 IN (1, 3) AND c_nationkey % 6 BETWEEN 1 AND 4 THEN 'P' || (c_nationkey % 6) END AS seat,
  CASE WHEN kind = 'Markers' THEN 'markers' WHEN c_custkey % 4 = 2 OR kind = 'clock' THEN 'sync' ELSE 'other' END AS stream,
  CASE c_custkey % 4 WHEN 0 THEN 'gaze' || (c_nationkey % 6) || '_stream' WHEN 1 THEN 'tablet_' || (c_nationkey % 6) WHEN 2 THEN c_nationkey || '_x' ELSE 'dpa_mic' || c_nationkey END AS stream_key FROM n""")
def stream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of streams that tell their seat, kind and device in several ways."""
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    seat = (F.col("c_nationkey") % 6).cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("gaze"), seat, F.lit("_stream"))).when(k % 4 == 1, F.concat(F.lit("Tablet "), seat)).when(k % 4 == 2, F.concat(F.lit("ffmpeg_progress_acq--"), n, F.lit("..x"))).otherwise(F.concat(F.lit("AUX-P"), seat, F.lit("-DPA_mic"), n))
    kind = F.when(k % 3 == 0, "Markers").when(k % 3 == 1, "clock").otherwise("gaze")
    c = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), kind.alias("kind"))
    return c.select("c_custkey", ctx.routed_seat(F.col("name"), "gaze").alias("routed"), sc.seat_of(F.col("name")).alias("seat"), sc.stream_kind(F.col("name"), F.col("kind")).alias("stream"), sc.canonical_key(F.col("name")).alias("stream_key"))


@query(_with("p AS (SELECT participant, avg(x) AS valence, count(*) AS arousal FROM samples GROUP BY ALL)", "q AS (SELECT participant, avg(event_id % 10) AS calm, max(x) AS tired FROM samples WHERE event_type = 'view' GROUP BY ALL)",
  "j AS (SELECT 'valence' AS prediction, 'calm' AS answer, CAST(valence AS DOUBLE) AS a, CAST(calm AS DOUBLE) AS b FROM p JOIN q USING (participant) UNION ALL SELECT 'arousal', 'tired', arousal, tired FROM p JOIN q USING (participant))",
  "c AS (SELECT prediction, answer, count(*) AS n, corr(a, b) AS r FROM j WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)")
  + " SELECT prediction, answer, n, round(r, 8) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM c")
def questionnaire_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    p = s.groupBy("participant").agg(F.avg("x").alias("valence"), F.count("*").alias("arousal"))
    q = s.where("event_type = 'view'").groupBy("participant").agg(F.avg(F.col("event_id") % 10).alias("calm"), F.max("x").alias("tired"))
    return ctx.paired_correlations(p, q, ["participant"], [("valence", "calm"), ("arousal", "tired")]).withColumn("r", F.round("r", 8)).withColumn("t", F.round("t", 6))


@query("""WITH f AS (SELECT l_orderkey % 50 AS camera, l_orderkey * 10 + l_linenumber AS frame, l_quantity AS media FROM lineitem), g AS (SELECT camera, frame, media * 2 AS "at" FROM f WHERE frame % 3 = 0), w AS (SELECT DISTINCT camera, camera * 1000.0 AS start FROM f WHERE camera % 5 > 0)
SELECT camera, frame, CAST(coalesce("at", start + media) AS DOUBLE) AS "time", CASE WHEN "at" IS NOT NULL THEN 'log' WHEN start IS NOT NULL THEN 'window' END AS source FROM f LEFT JOIN g USING (camera, frame) LEFT JOIN w USING (camera)""")
def frame_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("camera"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame"), F.col("l_quantity").cast("double").alias("media"))
    log = f.where("frame % 3 = 0").select("camera", "frame", (F.col("media") * 2).alias("at"))
    windows = f.where("camera % 5 > 0").select("camera").distinct().withColumn("start", F.col("camera") * 1000.0)
    return ctx.frame_times(f.select("camera", "frame", "media"), log, windows, "camera", "frame", "media").select("camera", "frame", "time", "source")


@query(_with("r AS (SELECT session, min(us) // 864000000000 AS date, list_sort(list(DISTINCT CASE WHEN session % 5 > 0 THEN event_type END) FILTER (WHERE session % 5 > 0)) AS names FROM samples GROUP BY ALL)",
  "s AS (SELECT session, max(us) // 864000000000 AS date, list_sort(list(DISTINCT event_type)) AS names FROM samples WHERE event_type <> 'signup' OR session % 3 = 0 GROUP BY ALL HAVING session % 7 > 0)",
  "j AS (SELECT r.session, r.date, coalesce(r.names, []) AS names, s.date AS d, s.names AS n, s.session IS NOT NULL AS known FROM r LEFT JOIN s USING (session))",
  "k AS (SELECT *, list_sort(list_filter(n, lambda v: NOT list_contains(names, v))) AS missing, list_sort(list_filter(names, lambda v: NOT list_contains(n, v))) AS extra FROM j)")
  + """ SELECT session, CASE WHEN known THEN CASE WHEN date = d THEN 'OK' ELSE 'DIFF' END END AS date_check,
  CASE WHEN NOT known THEN NULL WHEN len(names) = 0 THEN 'NO_NAMES' WHEN len(missing) = 0 AND len(extra) = 0 THEN 'OK' WHEN list_has_any(names, n) THEN 'PARTIAL' ELSE 'MISMATCH' END AS names_check,
  CASE WHEN known THEN array_to_string(missing, '|') END AS missing, CASE WHEN known THEN array_to_string(extra, '|') END AS extra FROM k""")  # fmt: skip
def schedule_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-day dates and names of signals, as reported and as scheduled."""
    s = samples(spark, sf_dir)
    names = F.array_sort(F.collect_set("event_type"))
    r = s.groupBy("session").agg(F.floor(F.min("us") / 864_000_000_000).alias("date"), names.alias("names")).withColumn("names", F.when(F.col("session") % 5 > 0, F.col("names")).otherwise(F.array().cast("array<string>")))
    plan = s.where("(event_type != 'signup' or session % 3 = 0) and session % 7 > 0").groupBy("session").agg(F.floor(F.max("us") / 864_000_000_000).alias("date"), names.alias("names"))
    return ctx.schedule_check(r, plan, "session")


@query("""WITH l AS (SELECT 's' || c_custkey AS name, 'g' || c_nationkey || '-' || (c_custkey // 50) AS sig FROM customer WHERE c_custkey % 3 > 0), r AS (SELECT 's' || (CASE WHEN c_custkey % 4 = 0 THEN -c_custkey ELSE c_custkey END) AS name, 'g' || (CASE WHEN c_custkey % 8 = 1 THEN 99 ELSE c_nationkey END) || '-' || (c_custkey // 50) AS sig FROM customer WHERE c_custkey % 5 > 0),
b AS (SELECT l.name AS l_name, r.name AS r_name, CASE WHEN l.sig = r.sig THEN 'high' ELSE 'medium' END AS quality FROM l JOIN r ON l.name = r.name),
fl AS (SELECT name, sig, row_number() OVER (PARTITION BY sig ORDER BY name) AS k FROM l WHERE name NOT IN (SELECT name FROM r)), fr AS (SELECT name, sig, row_number() OVER (PARTITION BY sig ORDER BY name) AS k FROM r WHERE name NOT IN (SELECT name FROM l))
SELECT * FROM b UNION ALL SELECT fl.name, fr.name, CASE WHEN fl.name IS NULL OR fr.name IS NULL THEN 'single-source' ELSE 'low' END FROM fl FULL JOIN fr ON fl.sig = fr.sig AND fl.k = fr.k""")
def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of sessions, some renamed and some with another signature."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    text = lambda *x: F.concat(*[v.cast("string") if not isinstance(v, str) else F.lit(v) for v in x])
    part = F.floor(k / 50)
    left = c.where(k % 3 > 0).select(text("s", k).alias("name"), text("g", F.col("c_nationkey"), "-", part).alias("sig"))
    right = c.where(k % 5 > 0).select(text("s", F.when(k % 4 == 0, -k).otherwise(k)).alias("name"), text("g", F.when(k % 8 == 1, 99).otherwise(F.col("c_nationkey")), "-", part).alias("sig"))
    return ctx.alias_match(left, right, "name", "sig")


@query(_with() + """ SELECT session, task, seat, count(*) AS annotations, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'error') AS n_error, CASE WHEN count(*) >= 2 THEN max(us) - min(us) END AS span FROM samples GROUP BY ALL""")
def annotation_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctx.annotation_activity(samples(spark, sf_dir), ["session", "task", "seat"], "event_type", "us", ["click", "error"])


@query(_with() + " SELECT session % 10 AS grp, count(DISTINCT session) AS sessions, count(DISTINCT task) AS phases, count(DISTINCT participant) AS people, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS modalities FROM samples GROUP BY ALL")
def group_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctx.inventory(samples(spark, sf_dir).withColumn("grp", F.col("session") % 10), "grp", "session", "task", "participant", "event_type")


@query(_with("r AS (SELECT event_id, participant, row_number() OVER (PARTITION BY participant ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY participant) AS n FROM samples)",
  "p AS (SELECT DISTINCT participant, n, CASE WHEN n <= 7 THEN i ELSE i * (n - 1) // 6 END AS r FROM (SELECT DISTINCT participant, n FROM r), unnest(range(0, least(n, 7))) u(i))")
  + " SELECT event_id FROM r JOIN p USING (participant, n, r)")
def even_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven samples a user, evenly spaced by rank."""
    return ctx.evenly(samples(spark, sf_dir).select("event_id", "participant"), ["participant"], "event_id", 7).select("event_id")


@query(_with() + " SELECT event_id FROM samples QUALIFY row_number() OVER (PARTITION BY participant ORDER BY event_id) <= 3")
def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three samples of each user: the row cap is the feature."""
    return ctx.first_rows(samples(spark, sf_dir).select("event_id", "participant"), ["participant"], "event_id", 3).select("event_id")


@query(_with() + " SELECT participant, min(event_id) AS event_id, arg_min(us, event_id) AS us, arg_min(x, event_id) AS x FROM samples GROUP BY ALL")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctx.first_sample(samples(spark, sf_dir), ["participant"], "event_id", ["us", "x"])


@query(_with() + " SELECT event_id, x FROM samples ORDER BY md5('11:' || event_id), event_id LIMIT 500")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred samples in hashed order: sampling is the feature."""
    return ctx.seeded_sample(samples(spark, sf_dir).select("event_id", "x"), "event_id", 11, 500)


@query("SELECT 'c' || c_custkey AS who, c_acctbal AS balance, NULL AS phone FROM customer UNION ALL SELECT 's' || s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'n' || n_nationkey, NULL, n_name FROM nation")
def session_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables with differing columns as one."""
    who = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("who")
    parts = [table(spark, sf_dir, "customer").select(who("c", "c_custkey"), F.col("c_acctbal").alias("balance")), table(spark, sf_dir, "supplier").select(who("s", "s_suppkey"), F.col("s_acctbal").alias("balance")), table(spark, sf_dir, "nation").select(who("n", "n_nationkey"), F.col("n_name").alias("phone"))]
    return ctx.union_tables(parts)


@query(_with("a AS (SELECT session, list(DISTINCT event_type) AS a FROM samples WHERE task < 2 GROUP BY ALL)", "b AS (SELECT session, list(DISTINCT event_type) AS b FROM samples WHERE task > 2 GROUP BY ALL)")
  + " SELECT session, array_to_string(list_sort(list_intersect(a, b)), '|') AS both, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), '|') AS only_a, array_to_string(list_sort(list_filter(b, lambda v: NOT list_contains(a, v))), '|') AS only_b, list_has_any(a, b) AS meet FROM a JOIN b USING (session)")
def set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the early and the late tasks of a session."""
    s = samples(spark, sf_dir)
    names = lambda when, n: s.where(when).groupBy("session").agg(F.collect_set("event_type").alias(n))
    c = names("task < 2", "a").join(names("task > 2", "b"), "session").withColumn("c", ctx.compare_sets(F.col("a"), F.col("b")))
    return c.select("session", *[F.array_join(F.col(f"c.{n}"), "|").alias(n) for n in ("both", "only_a", "only_b")], F.col("c.meet").alias("meet"))


@query(_with("h AS (SELECT DISTINCT participant FROM samples WHERE event_type = 'error')") + " SELECT seat, count(*) AS n, round(avg(x), 9) AS mean FROM samples WHERE participant NOT IN (SELECT participant FROM h) GROUP BY ALL")
def held_out_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats' means over users without any error."""
    s = samples(spark, sf_dir)
    return ctx.without(s, s.where("event_type = 'error'").select("participant").distinct(), ["participant"]).groupBy("seat").agg(F.count("*").alias("n"), F.round(F.avg("x"), 9).alias("mean"))
