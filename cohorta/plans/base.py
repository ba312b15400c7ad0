"""The driver's tables in the roles of the domain: samples, task phases, utterances, answers.

An events row is a sample of a user; four users are a group, its place in it a seat; each
user's time is cut into five equal task phases; an ``error`` row is an invalid sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

#: The same rows in SQL; queries' SQL starts with ``WITH`` and this.
SAMPLES_SQL = """samples AS (
  SELECT event_id, us, us / 1e6 AS t, user_id AS participant, user_id // 4 AS session, CAST(user_id % 4 AS INTEGER) AS seat,
    event_type, event_type <> 'error' AS valid, value AS x, props,
    CASE WHEN last = first THEN 0 ELSE CAST(least(4, (5 * (us - first)) // (last - first)) AS INTEGER) END AS task
  FROM (SELECT *, min(us) OVER (PARTITION BY user_id) AS first, max(us) OVER (PARTITION BY user_id) AS last
        FROM (SELECT *, epoch_us(ts) AS us FROM events))
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    """Whole microseconds since 1970 of a timestamp without zone, read as UTC."""
    c = F.col(ts)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("us", micros("ts"))
    w = Window.partitionBy("user_id")
    first, last = F.min("us").over(w), F.max("us").over(w)
    task = F.when(last == first, 0).otherwise(F.least(F.lit(4), F.floor(5 * (F.col("us") - first) / (last - first)).cast("int")))
    return e.withColumn("task", task).select(
        "event_id", "us", (F.col("us") / 1e6).alias("t"), F.col("user_id").alias("participant"), F.floor(F.col("user_id") / 4).alias("session"),
        (F.col("user_id") % 4).cast("int").alias("seat"), "event_type", (F.col("event_type") != "error").alias("valid"), F.col("value").alias("x"), "props", "task",
    )


def day_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seat, frame (the day), n and total of the values of each user and day, added up one by one in the order of events.

    A sum of doubles depends on the order of its terms in the last digits, and a frame at a threshold on those; so
    neither the files nor the tasks that a day is dealt to may choose it.
    """
    by = ["participant", "frame"]
    s = samples(spark, sf_dir).withColumn("frame", F.floor(F.col("us") / DAY_US)).select("session", "seat", *by, "event_id", "x")
    w = Window.partitionBy(*by).orderBy("event_id", "x")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.select("session", "seat", "frame", F.count("x").over(so_far).alias("n"), F.sum("x").over(so_far).alias("total"), F.lead(F.lit(1)).over(w).alias("_next"))
    return s.where("_next is null").drop("_next")
