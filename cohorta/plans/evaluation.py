"""Queries of the label and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import evaluate as ev
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

#: Labels and predictions 0 to 2 from lineitem: what the quantity is, and what the discount suggests.
LABELS_SQL = "labelled AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_quantity <= 16 THEN 0 WHEN l_quantity <= 33 THEN 1 ELSE 2 END AS y, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN (CASE WHEN l_quantity <= 16 THEN 0 WHEN l_quantity <= 33 THEN 1 ELSE 2 END) ELSE CAST(l_orderkey % 3 AS INTEGER) END AS p, l_quantity, l_discount FROM lineitem)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    y = F.when(q <= 16, 0).when(q <= 33, 1).otherwise(2)
    p = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, y).otherwise((F.col("l_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", y.alias("y"), p.alias("p"), "l_quantity", "l_discount")


@query(_with("s AS (SELECT seat, x, row_number() OVER (PARTITION BY seat ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY seat) AS n FROM samples)",
  "b AS (SELECT seat, max(CASE WHEN r = n // 3 THEN x END) AS b1, max(CASE WHEN r = 2 * n // 3 THEN x END) AS b2 FROM s GROUP BY ALL)",
  "l AS (SELECT seat, b1, b2, max(CASE WHEN x < b1 THEN x END) AS l1, max(CASE WHEN x < b2 THEN x END) AS l2 FROM s JOIN b USING (seat) GROUP BY ALL)")
  + " SELECT seat, round((b1 + l1) / 2, 9) AS t1, round((b2 + l2) / 2, 9) AS t2 FROM l")
def tertile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ev.tertile_thresholds(samples(spark, sf_dir), ["seat"], "x")
    return t.select("seat", F.round("t1", 9).alias("t1"), F.round("t2", 9).alias("t2"))


@query(_with() + " SELECT participant, CASE WHEN count(x) < 3 THEN 3 ELSE quantile_cont(x, 0.33) END AS t1, CASE WHEN count(x) < 3 THEN 6 ELSE quantile_cont(x, 0.67) END AS t2 FROM samples WHERE event_type = 'view' GROUP BY ALL")
def percentile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.percentile_thresholds(samples(spark, sf_dir).where("event_type = 'view'"), ["participant"], "x")


@query(f"WITH {LABELS_SQL}, n AS (SELECT y, count(*) AS n FROM labelled GROUP BY ALL), w AS (SELECT y, sum(n) OVER () / (3 * n) AS w FROM n) SELECT y, round(w / sum(w) OVER (), 9) AS weight FROM w")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.class_weights(_labelled(spark, sf_dir), "y", 3).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {LABELS_SQL}, c AS (SELECT CASE WHEN l_quantity = 50 THEN 1.0 ELSE l_quantity / 50 END AS c, y = p AS ok FROM labelled), b AS (SELECT floor(c * 10) AS b, count(*) AS n, avg(c) AS c, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS a FROM c WHERE c < 1 GROUP BY 1)
SELECT round(sum(n / (SELECT count(*) FROM c) * abs(a - c)), 9) AS ece FROM b""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _labelled(spark, sf_dir).select(F.when(F.col("l_quantity") == 50, 1.0).otherwise(F.col("l_quantity") / 50).alias("c"), (F.col("y") == F.col("p")).alias("ok"))
    return ev.calibration_error(c, "c", "ok").withColumn("ece", F.round("ece", 9))


@query(f"""WITH {LABELS_SQL}, k AS (SELECT l_returnflag, unnest([0, 1, 2]) AS k, unnest([count(*) FILTER (WHERE y = 0 AND p = 0), count(*) FILTER (WHERE y = 1 AND p = 1), count(*) FILTER (WHERE y = 2 AND p = 2)]) AS tp,
  unnest([count(*) FILTER (WHERE y = 0) + count(*) FILTER (WHERE p = 0), count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE p = 1), count(*) FILTER (WHERE y = 2) + count(*) FILTER (WHERE p = 2)]) AS s FROM labelled GROUP BY l_returnflag),
a AS (SELECT l_returnflag, count(*) AS n, avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) AS accuracy FROM labelled GROUP BY ALL)
SELECT l_returnflag, any_value(n) AS n, round(any_value(accuracy), 9) AS accuracy, round(avg(2 * tp / s), 9) AS macro_f1 FROM k JOIN a USING (l_returnflag) GROUP BY l_returnflag""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.classification(_labelled(spark, sf_dir), ["l_returnflag"], "y", "p", 3)
    return m.select("l_returnflag", "n", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {LABELS_SQL} SELECT y, p, count(*) AS n FROM labelled GROUP BY ALL")
def confusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(_labelled(spark, sf_dir), "y", "p")


@query("""WITH o AS (SELECT l_returnflag, 1 + l_linenumber AS y, 1 + (l_orderkey + 3 * l_linenumber) % 9 AS p FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY l_returnflag ORDER BY p) + (count(*) OVER (PARTITION BY l_returnflag, p) - 1) / 2 AS rp FROM o)
SELECT l_returnflag, round(avg(abs(p - y)), 9) AS mae, round(corr(ry, rp), 8) AS spearman, round(1 - avg((p - y) ** 2) / (var_pop(p) + var_pop(y) + (avg(p) - avg(y)) ** 2), 8) AS qwk, round(avg(CASE WHEN abs(p - y) <= 1 THEN 1.0 ELSE 0 END), 9) AS within_1,
  round(avg(CASE WHEN (CASE WHEN y <= 3 THEN 0 WHEN y <= 6 THEN 1 ELSE 2 END) = (CASE WHEN p <= 3 THEN 0 WHEN p <= 6 THEN 1 ELSE 2 END) THEN 1.0 ELSE 0 END), 9) AS accuracy_3 FROM r GROUP BY ALL""")
def ordinal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select("l_returnflag", (1 + F.col("l_linenumber")).cast("double").alias("y"), (1 + (F.col("l_orderkey") + 3 * F.col("l_linenumber")) % 9).cast("double").alias("p"))
    m = ev.ordinal_metrics(o, ["l_returnflag"], "y", "p", 9, (3, 6))
    return m.select("l_returnflag", *[F.round(c, 8 if c in ("spearman", "qwk") else 9).alias(c) for c in m.columns[1:]])


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.bootstrap(_labelled(spark, sf_dir), "y", "p", 3, seed=7)


@query(f"WITH {LABELS_SQL} SELECT l_returnflag, round((avg(l_quantity) FILTER (WHERE p = 2) - avg(l_quantity) FILTER (WHERE p <> 2)) / sqrt((var_pop(l_quantity) FILTER (WHERE p = 2) + var_pop(l_quantity) FILTER (WHERE p <> 2)) / 2), 8) AS d FROM labelled GROUP BY ALL")
def effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.effect_size(_labelled(spark, sf_dir), ["l_returnflag"], F.col("p") == 2, "l_quantity").withColumn("d", F.round("d", 8))


@query("""WITH v AS (SELECT vec_id // 4 AS session, vec_id AS seat, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT a.session, a.seat, avg(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))) AS c FROM v a JOIN v b ON a.session = b.session AND a.seat <> b.seat GROUP BY ALL)
SELECT v.session, v.seat, round(least(greatest(coalesce(c, 0.5), 0), 1), 8) AS trust FROM v LEFT JOIN p USING (session, seat)""")
def trait_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as traits: four in a row are a session."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("session"), F.col("vec_id").alias("seat"), "embedding")
    return ev.trait_trust(v, "session", "seat", "embedding").withColumn("trust", F.round("trust", 8))


@query("""WITH v AS (SELECT vec_id, label AS stimulus, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT t.vec_id, t.stimulus, greatest(list_dot_product(t.e, r.e) / (sqrt(list_dot_product(t.e, t.e)) * sqrt(list_dot_product(r.e, r.e))), 0.05) AS w, r.vec_id % 9 AS y FROM v t JOIN v r ON t.stimulus = r.stimulus AND t.vec_id <> r.vec_id WHERE t.vec_id % 5 = 0 AND r.vec_id % 5 <> 0)
SELECT vec_id, stimulus, round(sum(w * y) / sum(w), 8) AS label FROM p GROUP BY ALL""")
def weighted_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("stimulus"), "embedding", (F.col("vec_id") % 9).alias("y"))
    test, train = v.where("vec_id % 5 = 0").select("vec_id", "stimulus", "embedding"), v.where("vec_id % 5 != 0")
    return ev.weighted_transfer(test, train, "stimulus", "vec_id", "embedding", "y").withColumn("label", F.round("label", 8))


@query(_with() + " SELECT event_id, CASE task WHEN 3 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS role FROM samples WHERE task <= 3")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.temporal_split(samples(spark, sf_dir), "task", 3).select("event_id", "role")


@query(_with("r AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY us) AS r, count(*) OVER (PARTITION BY participant) AS n FROM samples)")
  + " SELECT event_id, CASE WHEN n < 3 OR r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * (0.6 + 0.2)) THEN 'val' ELSE 'test' END AS role FROM r")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.chronological_split(samples(spark, sf_dir), "participant", ["us"]).select("event_id", "role")


@query(_with("f AS (SELECT DISTINCT seat AS fold FROM samples)") + " SELECT fold, CASE WHEN fold = seat THEN 'test' ELSE 'train' END AS role, count(*) AS n, round(avg(x), 9) AS mean FROM samples, f GROUP BY ALL")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seat's rows as the test set once: the sizes and means of all folds."""
    return ev.leave_one_out(samples(spark, sf_dir), "seat", "x").withColumn("mean", F.round("mean", 9))


@query(_with("s AS (SELECT participant, row_number() OVER (ORDER BY min(event_id), participant) - 1 AS r, greatest(count(*) OVER () // 5, 1) AS size FROM samples GROUP BY participant)")
  + " SELECT participant, CAST(least(r // size, 4) AS INTEGER) AS fold FROM s")
def block_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.block_folds(samples(spark, sf_dir), "participant", "event_id", 5).select("participant", "fold").distinct()


@query()
def subject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.subject_split(samples(spark, sf_dir), "participant", 0.2, 0.1, 3).groupBy("participant").agg(F.first("role").alias("role"))
