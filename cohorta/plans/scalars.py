"""Queries of the scalar functions and of payload tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.functions import scalars as sc
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


@query(_with() + """ SELECT event_id, CASE WHEN x BETWEEN 5 AND 300 AND abs(x) < 250 THEN x END AS cleaned, round(coalesce((CASE WHEN valid THEN x END + CASE WHEN seat > 0 THEN x + 2 END) / 2, CASE WHEN valid THEN x END, CASE WHEN seat > 0 THEN x + 2 END), 9) AS pair,
  CASE WHEN NOT valid THEN 'Unknown' WHEN x <= 10 THEN 'Low' WHEN x >= 100 THEN 'High' ELSE 'Moderate' END AS label, CASE WHEN NOT valid THEN 1 WHEN x <= 20 THEN 0 WHEN x <= 60 THEN 1 ELSE 2 END AS class,
  round(greatest(20 * log10(greatest(x / 1e5, 1e-10)), -80), 9) AS db FROM samples""")
def scalar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range cleaning, pair means, labels, classes and decibels of every sample."""
    x, own = F.col("x"), F.when(F.col("valid"), F.col("x"))
    return samples(spark, sf_dir).select(
        "event_id", sc.in_range(x, 5, 300, 250).alias("cleaned"), F.round(sc.pair_mean(own, F.when(F.col("seat") > 0, x + 2)), 9).alias("pair"),
        sc.three_way(own, 10, 100, "Unknown").alias("label"), sc.rating_class(own, 20, 60).alias("class"), F.round(sc.decibels(x / 1e5), 9).alias("db"),
    )


@query(_with() + """ SELECT event_id, coalesce(nullif(concat_ws(';', CASE WHEN x > 200 THEN 'very_high' END, CASE WHEN NOT valid THEN 'invalid' END, CASE WHEN x < 1 THEN 'flat' END), ''), 'ok') AS qc,
  concat_ws(' ', CASE WHEN x > 200 THEN 'Check the sensor.' END, CASE WHEN NOT valid THEN 'Sample lost.' END, CASE WHEN x < 1 AND NOT coalesce(x > 200, false) THEN 'Check the sensor.' END) AS notes FROM samples""")
def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sc.flags(very_high=F.col("x") > 200, invalid=~F.col("valid"), flat=F.col("x") < 1)
    notes = {"very_high": "Check the sensor.", "invalid": "Sample lost.", "flat": "Check the sensor."}
    return samples(spark, sf_dir).withColumn("f", found).select("event_id", sc.flag_text(F.col("f")).alias("qc"), sc.flag_notes(F.col("f"), notes).alias("notes"))


@query(_with() + " SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM samples GROUP BY ALL")
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the JSON payloads, counted by event type."""
    entries = F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("e")
    each = samples(spark, sf_dir).where(F.trim("props").startswith("{")).select("event_type", entries)
    return each.where("e.key = 'k'").groupBy("event_type", F.col("e.value").try_cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT s_suppkey, 'sub-' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 2, '0') || '_ses-' || s_nationkey || '_task-T' || s_suppkey % 5 || '_acq-P' || (s_suppkey % 4 + 1) || '_physio.tsv' AS path FROM supplier)
SELECT s_suppkey, regexp_extract(path, 'task-([A-Za-z0-9]+)', 1) AS task, regexp_extract(path, 'acq-([A-Za-z0-9]+)', 1) AS seat, regexp_extract(path, 'ses-([A-Za-z0-9]+)', 1) AS session FROM n""")
def filename_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.concat(F.lit("sub-"), F.lpad((k % 40).cast("string"), 2, "0"), F.lit("_ses-"), F.col("s_nationkey").cast("string"), F.lit("_task-T"), (k % 5).cast("string"), F.lit("_acq-P"), (k % 4 + 1).cast("string"), F.lit("_physio.tsv"))
    s = table(spark, sf_dir, "supplier").withColumn("path", path)
    return s.select("s_suppkey", *[sc.entity(F.col("path"), e).alias(n) for e, n in (("task", "task"), ("acq", "seat"), ("ses", "session"))])


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 5 WHEN o_orderpriority LIKE '2%' THEN 4 WHEN o_orderpriority LIKE '3%' THEN 3 WHEN o_orderpriority LIKE '5%' THEN 1 END AS score,
  CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 WHEN o_orderpriority LIKE '3%' THEN 3 WHEN o_orderpriority LIKE '5%' THEN 5 END AS reversed,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 80 AS INTEGER) WHEN o_orderkey % 3 = 1 THEN 29 ELSE 65 END AS age FROM orders""")
def questionnaire_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as answers of a five-point item, plain and reversed, and ages from text or bands."""
    scale = {"1-urgent": 5, "2-high": 4, "3-medium": 3, "5-low": 1}
    k, text = F.col("o_orderkey"), F.col("o_orderpriority")
    exact = F.when(k % 3 == 0, (k % 80).cast("string")).otherwise("n/a")
    band = F.when(k % 3 == 1, "25 - 34").otherwise("65+")
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.item_score(text, scale).alias("score"), sc.item_score(text, scale, True).alias("reversed"), sc.age_years(exact, band).alias("age"))


@query(_with("w AS (SELECT participant, list_sort(list(us) FILTER (WHERE event_type = 'signup')) AS seen FROM samples GROUP BY ALL)")
  + " SELECT event_id, round(CASE WHEN event_type = 'view' THEN coalesce(exp(-list_min(list_transform(seen, lambda s: abs(us - s))) / 8.64e10), 0) END, 9) AS weight FROM samples JOIN w USING (participant)")
def decay_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near in time a view is to a signup of its user, as an exponential weight a day."""
    s = samples(spark, sf_dir)
    seen = s.groupBy("participant").agg(F.sort_array(F.collect_list(F.when(F.col("event_type") == "signup", F.col("us")))).alias("seen"))
    weight = F.when(F.col("event_type") == "view", sc.decay_weight(F.col("us"), F.col("seen"), 1 / 8.64e10))
    return s.join(seen, "participant").select("event_id", F.round(weight, 9).alias("weight"))


@query()
def soft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's normal posterior cut at two thresholds, and what it says of nine ordered classes."""
    mu = F.least(F.col("x") / 10, F.lit(9.0))
    return samples(spark, sf_dir).select("event_id", sc.soft_label(mu, F.lit(1.2), 3.0, 6.0).alias("soft"), sc.ordinal_targets(F.round(mu), 9, 1.0).alias("targets"))


@query("""WITH c AS (SELECT o_orderkey, o_totalprice / 1e5 - 2 AS x, (o_orderkey % 100) / 50.0 - 1 AS y FROM orders)
SELECT o_orderkey, round(CASE WHEN x BETWEEN -0.2 AND 1.2 AND y BETWEEN -0.2 AND 1.2 THEN x * 1920 ELSE x END, 10) AS px, round(CASE WHEN x BETWEEN -0.2 AND 1.2 AND y BETWEEN -0.2 AND 1.2 THEN y * 1080 ELSE y END, 10) AS py,
  round(CASE WHEN -2 / nullif(y - 0.5, 0) > 0 THEN x + -2 / (y - 0.5) * x END, 10) AS wx FROM c""")
def gaze_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaze as pixels, and where its ray from two above meets the desk."""
    c = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e5 - 2).alias("x"), ((F.col("o_orderkey") % 100) / 50 - 1).alias("y"))
    p = sc.to_pixels(F.col("x"), F.col("y"), 1920, 1080)
    hit = sc.hit_plane([F.col("x"), F.lit(0.0), F.lit(2.0)], [F.col("x"), F.lit(0.0), F.col("y") - 0.5])
    return c.select("o_orderkey", F.round(p["px"], 10).alias("px"), F.round(p["py"], 10).alias("py"), F.round(hit["wx"], 10).alias("wx"))
