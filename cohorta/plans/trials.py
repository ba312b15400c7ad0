"""Queries of stimulus trials, window tables, smoothed tracks and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohorta.operators import trials as tr
from cohorta.operators.states import results_table
from cohorta.plans.base import DAY_US, samples, table
from cohorta.plans.states import HOUR_US, _with

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(c, 7).alias(c) for c in df.columns if c not in keys])


@query(_with("c AS (SELECT participant, task, us, event_id, CAST(floor(x * 3600000000.0) AS BIGINT) AS span, event_type = 'view' AS v, bool_or(event_type = 'view') OVER (PARTITION BY participant, task) AS shown FROM samples)",
  f"w AS (SELECT participant, task, arg_min(us, event_id) AS onset, arg_min(us, event_id) + greatest({HOUR_US}, arg_min(span, event_id)) AS until FROM c WHERE v = shown GROUP BY ALL)")
  + " SELECT w.participant, w.task, onset, until, count(*) AS n, round(avg(x), 7) AS mean FROM w JOIN samples s ON s.participant = w.participant AND us BETWEEN onset AND until GROUP BY ALL")
def trial_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's phases as trials: from its first view, for as many hours as that view's value."""
    s = samples(spark, sf_dir).withColumn("span", F.floor(F.col("x") * 3600000000.0))
    labels = s.select("participant", "task").distinct()
    w = tr.stimulus_windows(labels, s, ["participant", "task"], "event_id", "us", "span", "event_type", "view", HOUR_US, 5 * HOUR_US)
    inside = tr.trial_samples(s.select("participant", "us", "x"), w, ["participant"], "us", DAY_US)
    return inside.groupBy("participant", "task", F.col("from").alias("onset"), "until").agg(F.count("*").alias("n"), F.round(F.avg("x"), 7).alias("mean"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y and z are roots, so that no mean of them lies half way between two roundings; x is missing in invalid samples, y in views."""
    y = F.when(F.col("event_type") != "view", F.sqrt((F.col("event_id") % 100).cast("double")))
    root = F.sqrt(F.abs("x"))
    return samples(spark, sf_dir).withColumns({"x": F.when(F.col("valid"), root), "y": y, "z": root / 1000})


TRACKS_SQL = "tracks AS (SELECT participant, task, event_id, event_type, valid, CASE WHEN valid THEN sqrt(abs(x)) END AS x, CASE WHEN event_type <> 'view' THEN sqrt((event_id % 100)::DOUBLE) END AS y, sqrt(abs(x)) / 1000 AS z FROM samples)"
_FILL = "coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY participant, task ORDER BY event_id), {d})"


@query(_with(TRACKS_SQL, f"g AS (SELECT participant, task, event_id, valid, {_FILL.format(c='x', d=0.5)} AS x, {_FILL.format(c='y', d=0.5)} AS y FROM tracks)",
  "h AS (SELECT *, sqrt((x - lag(x) OVER q) ** 2 + (y - lag(y) OVER q) ** 2) AS step FROM g WINDOW q AS (PARTITION BY participant, task ORDER BY event_id))")
  + " SELECT participant, task, round(avg(x), 7) AS x_mean, round(stddev_pop(x), 7) AS x_std, round(avg(y), 7) AS y_mean, round(stddev_pop(y), 7) AS y_std, round(avg(valid::INT), 7) AS validity_rate, round(coalesce(avg(step), 0), 7) AS saccade_proxy FROM h GROUP BY ALL")
def trial_gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaze summary of every phase of a user."""
    keys = ["participant", "task"]
    return _rounded(tr.gaze_summary(_tracks(spark, sf_dir), keys, "event_id", "x", "y", "valid"), keys)


@query(_with(TRACKS_SQL, "p AS (SELECT participant, task, nullif(x, 0) AS x, nullif(y, 0) AS y, valid FROM tracks)")
  + """ SELECT participant, task, round(coalesce(avg(x), 0), 7) AS x_mean, round(coalesce(stddev_pop(x), 0), 7) AS x_std, round(coalesce(avg(y), 0), 7) AS y_mean, round(coalesce(stddev_pop(y), 0), 7) AS y_std,
  round(coalesce(avg((coalesce(x, y) + coalesce(y, x)) / 2), 0), 7) AS pupil_mean, round(coalesce(stddev_pop((coalesce(x, y) + coalesce(y, x)) / 2), 0), 7) AS pupil_std, round(1 - avg(valid::INT), 7) AS blink_rate FROM p GROUP BY ALL""")  # fmt: skip
def trial_pupils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pupil summary of every phase of a user, with x and y as the two sizes."""
    keys = ["participant", "task"]
    return _rounded(tr.pupil_summary(_tracks(spark, sf_dir), keys, "x", "y", "valid"), keys)


@query(_with(TRACKS_SQL, f"g AS (SELECT participant, task, event_id, {_FILL.format(c='x', d=0)} AS x, count(*) OVER (PARTITION BY participant, task) AS n FROM tracks)",
  "e AS (SELECT participant, task, n, x, sum(x) OVER (PARTITION BY participant, task ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS tonic FROM g)",
  "f AS (SELECT participant, task, CASE WHEN n >= 4 THEN tonic END AS tonic, CASE WHEN n >= 4 THEN x - tonic END AS phasic FROM e)")
  + " SELECT participant, task, round(coalesce(avg(tonic), 0), 7) AS tonic_mean, round(coalesce(stddev_pop(tonic), 0), 7) AS tonic_std, round(coalesce(avg(phasic), 0), 7) AS phasic_mean, round(coalesce(stddev_pop(phasic), 0), 7) AS phasic_std FROM f GROUP BY ALL")
def trial_conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tonic and phasic parts of the values of every phase of a user, four rows wide."""
    keys = ["participant", "task"]
    return _rounded(tr.conductance_summary(_tracks(spark, sf_dir), keys, "event_id", "x", 4), keys)


@query(_with(TRACKS_SQL, f"g AS (SELECT participant, task, {_FILL.format(c='x', d=0)} AS x, {_FILL.format(c='y', d=0)} AS y, {_FILL.format(c='z', d=0)} AS z FROM tracks)", "m AS (SELECT *, sqrt(x * x + y * y + z * z) AS acc FROM g)")
  + " SELECT participant, task, " + ", ".join(f"round(avg({c}), 7) AS {c}_mean, round(stddev_pop({c}), 7) AS {c}_std" for c in ("x", "y", "z", "acc")) + " FROM m GROUP BY ALL")
def trial_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes and their length in every phase of a user."""
    keys = ["participant", "task"]
    return _rounded(tr.motion_summary(_tracks(spark, sf_dir), keys, "event_id", ["x", "y", "z"], "acc"), keys)


@query("""WITH w AS (SELECT o_custkey, o_orderkey, 'T' || o_orderpriority[1] AS task, epoch_us(o_orderdate) / 1e6 AS s, o_totalprice::DOUBLE AS p FROM orders)
  SELECT o_custkey, task, arg_max(s, o_orderkey) AS start, arg_max(s + p, o_orderkey) AS "end" FROM w WHERE task IN ('T0', 'T1', 'T2', 'T3', 'T4') GROUP BY ALL""")  # fmt: skip
def task_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's latest order of each priority as a task of a window table."""
    o = table(spark, sf_dir, "orders")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    rows = o.select("o_custkey", "o_orderkey", F.concat(F.lit(" T"), F.substring("o_orderpriority", 1, 1)).alias("task"), start.alias("start"), (start + F.col("o_totalprice").cast("double")).alias("end"))
    return tr.task_bounds(rows, ["o_custkey"], "o_orderkey", "task", "start", "end", [f"T{k}" for k in range(5)])


@query("SELECT o_custkey, arg_min(o_totalprice::DOUBLE, o_orderkey) FILTER (o_orderstatus = 'P') AS off FROM orders GROUP BY ALL")
def first_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of a customer's first pending order; other orders have text in its place."""
    o = table(spark, sf_dir, "orders")
    off = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice").cast("double").cast("string")).when(F.col("o_orderstatus") == "F", "").otherwise("n/a")
    return tr.first_offset(o.withColumn("off", off), ["o_custkey"], "o_orderkey", "off")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("participant").orderBy("us", "event_id")
    return _tracks(spark, sf_dir).where("x IS NULL OR event_id % 50 > 0").withColumn("i", F.row_number().over(w))


@query()
def smoothed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of a user as a track of 30 frames a second."""
    return tr.smoothed_tracks(_frames(spark, sf_dir), ["participant"], "i", ["x", "z"], 30.0)


@query()
def augmented_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variations of the values of every phase of a user."""
    trace = F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "x"))), lambda r: r["x"])
    s = samples(spark, sf_dir).groupBy("participant", "task").agg(trace.alias("sequence"))
    return tr.augmented(s.withColumn("key", F.concat_ws("/", "participant", "task")), "key", "sequence", 2)


_SCORE = "SELECT '{v}' AS variant, session, avg(abs(x - f)) AS error FROM (SELECT session, x, {e} AS f FROM samples WINDOW q AS (PARTITION BY participant ORDER BY us, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) WHERE f IS NOT NULL GROUP BY ALL"


@query(_with("e AS (" + " UNION ALL ".join(_SCORE.format(v=f"last_{n}", e="avg(x) OVER q", n=n) for n in (1, 3, 10)) + ")",
  "t AS (SELECT variant, avg(error) FILTER (session = 0) AS a, avg(error) FILTER (session = 1) AS b, avg(error) AS m FROM e GROUP BY ALL)")
  + " SELECT variant, round(a, 7) AS fold_0, round(b, 7) AS fold_1, round(m, 7) AS mean, round(m - (SELECT m FROM t WHERE variant = 'last_1'), 7) AS delta FROM t")
def variant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the mean of the last 1, 3 or 10 values of a user tells the next one, by group."""

    def mean_of_last(n: int):
        w = Window.partitionBy("participant").orderBy("us", "event_id").rowsBetween(-n, -1)
        return lambda s: s.withColumn("f", F.avg("x").over(w))

    score = lambda s: s.where("f IS NOT NULL").groupBy("session").agg(F.avg(F.abs(F.col("x") - F.col("f"))).alias("error"))
    scores = tr.variant_scores(samples(spark, sf_dir), {f"last_{n}": mean_of_last(n) for n in (1, 3, 10)}, score)
    return _rounded(results_table(scores, "variant", "session", "error", [0, 1], "last_1"), ["variant"])
