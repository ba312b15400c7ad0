"""Labelled window sets: thresholds, weights, acceptance, splits, transfer, metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.operators.group import average_ranks, pearson


def tertile_thresholds(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """t1 and t2: half way from the sorted value at n // 3 (2n // 3) to the next lower distinct value.

    Without a lower value the threshold is that value less 0.5. A t2 that is not above t1 moves
    half way from t1 to the first value above t1 + 0.5, or to t1 + 1. Distinct values are counted first.
    """
    w = Window.partitionBy(*keys)
    n = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("_m"))
    up = w.orderBy(c)
    n = n.withColumn("_z", F.sum("_m").over(up)).withColumn("_n", F.sum("_m").over(w)).withColumn("_l", F.lag(c).over(up))
    bound = lambda share: F.max(F.when((F.floor(share * F.col("_n") / 3) < F.col("_z")) & (F.floor(share * F.col("_n") / 3) >= F.col("_z") - F.col("_m")), F.coalesce((F.col(c) + F.col("_l")) / 2, F.col(c) - 0.5)))
    t = n.withColumn("_1", bound(1).over(w)).withColumn("_2", bound(2).over(w))
    t = t.groupBy(*keys).agg(F.first("_1").alias("t1"), F.first("_2").alias("_t"), F.min(F.when(F.col(c) > F.col("_1") + 0.5, F.col(c))).alias("_above"))
    return t.select(*keys, "t1", F.when(F.col("_t") > F.col("t1"), F.col("_t")).otherwise(F.coalesce((F.col("t1") + F.col("_above")) / 2, F.col("t1") + 1)).alias("t2"))


def percentile_thresholds(df: DataFrame, keys: list[str], c: str, least: int = 3, fixed: tuple[float, float] = (3.0, 6.0)) -> DataFrame:
    few = F.count(c) < least
    return df.groupBy(*keys).agg(F.when(few, fixed[0]).otherwise(F.percentile(c, F.lit(0.33))).alias("t1"), F.when(few, fixed[1]).otherwise(F.percentile(c, F.lit(0.67))).alias("t2"))


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """total / (classes * count), an absent class as if it had one row, scaled to add up to 1."""
    n = df.where(F.col(label).between(0, classes - 1)).groupBy(label).agg(F.count("*").alias("_n"))
    every = df.sparkSession.range(classes).select(F.col("id").cast(dict(df.dtypes)[label]).alias(label))
    c = every.join(n, label, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    w = Window.partitionBy()  # one row a class
    c = c.withColumn("_w", F.sum("_n").over(w) / (classes * F.greatest("_n", F.lit(1))))
    return c.select(label, (F.col("_w") / F.sum("_w").over(w)).alias("weight"))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10, closed: bool = False) -> DataFrame:
    """Mean gap of confidence and accuracy over equal bins [low, high), by share of all rows.

    Confidence 1 falls in no bin unless ``closed``.
    """
    b = F.floor(F.col(confidence) * bins)
    b = F.when(F.col(confidence) == 1.0, bins - 1 if closed else None).otherwise(b)
    total = df.agg(F.count("*").alias("_t"))
    each = df.withColumn("_b", b).where(F.col("_b").between(0, bins - 1)).groupBy("_b").agg(F.count("*").alias("_n"), F.avg(confidence).alias("_c"), F.avg(F.col(correct).cast("double")).alias("_a"))
    return each.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("_n") / F.col("_t") * F.abs(F.col("_a") - F.col("_c"))), F.lit(0.0)).alias("ece"))


def accepted_pseudo_labels(df: DataFrame, soft: str, weight: str, least_weight: float, least_share: float = 0.5) -> DataFrame:
    """Rows whose weight and largest class share are high enough, with that class (the first of equals)."""
    top = F.array_max(soft)
    return df.where((F.col(weight) >= least_weight) & (top >= least_share)).withColumn("label", F.array_position(soft, top).cast("int") - 1)


def temporal_split(df: DataFrame, task: str, test: int) -> DataFrame:
    """Adds role: the test task, the one before it for validation, earlier ones for training.

    Task 0 has nothing before it and is refused; for task 1, task 0 serves both, as training.
    """
    if test <= 0:
        raise ValueError("task 0 cannot be the test task")
    role = F.when(F.col(task) == test, "test").when((F.col(task) == test - 1) & (test > 1), "val").when(F.col(task) < test, "train")
    return df.withColumn("role", role).where("role is not null")


def hash_order(keys: list[str], seed: int) -> Column:
    """A reproducible random order: any cluster size and partitioning gives the same."""
    return F.xxhash64(F.lit(seed), *keys)


def numbered(df: DataFrame, hashed: Column, name: str = "_r") -> DataFrame:
    """Adds a row's number, from 1, in the order of a 64-bit hash: counted within 4,096 ranges of it, then ranges added up."""
    cut = df.withColumn("_h", hashed).withColumn("_g", F.shiftright("_h", 52))
    sizes = cut.groupBy("_g").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_g")) - F.col("_n")).drop("_n")  # 4,096 rows at most
    return cut.join(before, "_g").withColumn(name, F.col("_b") + F.row_number().over(Window.partitionBy("_g").orderBy("_h"))).drop("_h", "_g", "_b")


def subject_split(df: DataFrame, subject: str, test: float, val: float, seed: int) -> DataFrame:
    """Adds role, whole subjects at a time, in hashed order (one subject at least for test and val)."""
    s = df.select(subject).distinct()
    n = s.agg(F.count("*").alias("_n"))
    r = numbered(s, hash_order([subject], seed)).crossJoin(F.broadcast(n))  # one row
    a = F.greatest(F.floor(F.col("_n") * test), F.lit(1))
    b = a + F.greatest(F.floor(F.col("_n") * val), F.lit(1))
    return df.join(r.select(subject, F.when(F.col("_r") <= a, "test").when(F.col("_r") <= b, "val").otherwise("train").alias("role")), subject)


def chronological_split(df: DataFrame, subject: str, order: list[str], train: float = 0.6, val: float = 0.2, least: int = 3) -> DataFrame:
    """Adds role: each subject's first rows train, the next validate, the last test; short subjects train."""
    w = Window.partitionBy(subject)
    r, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return df.withColumn("role", F.when((n < least) | (r <= F.floor(n * train)), "train").when(r <= F.floor(n * (train + val)), "val").otherwise("test"))


def leave_one_out(df: DataFrame, group: str, c: str) -> DataFrame:
    """Of each group's fold the rows and mean of its test set (the group) and training set (all others).

    A training set's figures are the totals less the group's own, so no row is copied. A fold
    without training rows has only its test row.
    """
    own = df.groupBy(F.col(group).alias("fold")).agg(F.count("*").alias("n"), F.sum(c).alias("_s"), F.count(c).alias("_m"))
    whole = own.agg(F.sum("n").alias("_tn"), F.sum("_s").alias("_ts"), F.sum("_m").alias("_tm"))  # one row
    rest = own.crossJoin(F.broadcast(whole)).select("fold", F.lit("train").alias("role"), (F.col("_tn") - F.col("n")).alias("n"), (F.col("_ts") - F.coalesce("_s", F.lit(0))).alias("_s"), (F.col("_tm") - F.col("_m")).alias("_m"))
    test = own.select("fold", F.lit("test").alias("role"), "n", "_s", "_m")
    return test.unionByName(rest.where("n > 0")).select("fold", "role", "n", F.try_divide("_s", "_m").alias("mean"))


def block_folds(df: DataFrame, subject: str, order: str, k: int) -> DataFrame:
    """Adds fold: consecutive blocks of n // k subjects in order of first sight, the rest in the last."""
    seen = df.groupBy(subject).agg(F.min(order).alias("_o"))
    n = seen.agg(F.greatest(F.floor(F.count("*") / k), F.lit(1)).alias("_size"))
    r = seen.withColumn("_r", F.row_number().over(Window.orderBy("_o", subject)) - 1).crossJoin(F.broadcast(n))
    return df.join(r.select(subject, F.least(F.floor(F.col("_r") / F.col("_size")), F.lit(k - 1)).cast("int").alias("fold")), subject)


def classification(df: DataFrame, keys: list[str], label: str, pred: str, classes: int) -> DataFrame:
    """Accuracy and macro F1 over labels 0 .. classes - 1; missing labels (null, -1) do not count.

    Classes without any row or prediction have F1 0 and count in the mean.
    """
    ok = df.where(F.col(label).between(0, classes - 1))
    f1 = []
    for k in range(classes):
        tp = F.sum(((F.col(label) == k) & (F.col(pred) == k)).cast("int"))
        both = F.sum((F.col(label) == k).cast("int")) + F.sum((F.col(pred) == k).cast("int"))
        f1.append(F.when(both > 0, 2 * tp / both).otherwise(0.0))
    mean = f1[0]
    for x in f1[1:]:
        mean = mean + x
    return ok.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"), (mean / classes).alias("macro_f1"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(label, pred).agg(F.count("*").alias("n"))


def ordinal_metrics(df: DataFrame, keys: list[str], label: str, pred: str, classes: int, cuts: tuple[float, float]) -> DataFrame:
    """MAE, Spearman (undefined: 0), quadratic weighted kappa, share within 1, 3-class accuracy."""
    d = F.col(pred) - F.col(label)
    three = lambda c: F.when(F.col(c) <= cuts[0], 0).when(F.col(c) <= cuts[1], 1).otherwise(2)
    r = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull())
    r = average_ranks(average_ranks(r, label, keys, "_rl"), pred, keys, "_rp").withColumn("_q", F.least(F.greatest(F.round(pred), F.lit(1)), F.lit(classes)))
    # The expected squared distance of independent draws needs only the moments of both sides.
    observed = F.avg((F.col("_q") - F.col(label)) ** 2)
    expected = F.var_pop("_q") + F.var_pop(label) + (F.avg("_q") - F.avg(label)) ** 2
    return r.groupBy(*keys).agg(F.avg(F.abs(d)).alias("mae"), F.coalesce(pearson("_rl", "_rp", 2), F.lit(0.0)).alias("spearman"), F.when(expected > 0, 1 - observed / expected).otherwise(0.0).alias("qwk"), F.avg((F.abs(d) <= 1).cast("double")).alias("within_1"), F.avg((three(label) == three(pred)).cast("double")).alias("accuracy_3"))


def bootstrap(df: DataFrame, label: str, pred: str, classes: int, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 percentiles of macro F1 over resamples of n rows out of n.

    Macro F1 depends only on how often each label meets each prediction, and resampling rows
    draws these counts from a multinomial. So the rows are read once, and each replicate is
    a seeded draw of at most classes * (classes + 1) counts. Predictions may be any number.
    """
    known = F.when(F.col(pred).between(0, classes - 1), F.col(pred)).otherwise(classes).cast("int").alias("p")
    cells = df.where(F.col(label).between(0, classes - 1)).groupBy(F.col(label).cast("int").alias("y"), known).agg(F.count("*").alias("n")).collect()
    table = np.zeros((classes, classes + 1))
    for r in cells:
        table[r["y"], r["p"]] = r["n"]
    n = int(table.sum())

    def draw(frames):
        for f in frames:
            out = []
            for rep in f["id"].tolist():
                t = np.random.default_rng([seed, rep]).multinomial(n, table.ravel() / max(n, 1)).reshape(table.shape)
                both = t.sum(axis=1) + t[:, :classes].sum(axis=0)
                out.append(float(np.mean(np.where(both > 0, 2 * np.diag(t) / np.maximum(both, 1), 0.0))) if n else None)
            yield pd.DataFrame({"f1": out})

    f1 = df.sparkSession.range(replicates).mapInPandas(draw, "f1 double")
    return f1.agg(F.percentile("f1", F.lit(0.025)).alias("low"), F.percentile("f1", F.lit(0.975)).alias("high"))


def effect_size(df: DataFrame, keys: list[str], group: Column, c: str) -> DataFrame:
    """Difference of the means of rows where ``group`` holds and of the others, over the pooled sd; 0 without spread."""
    a, b = F.when(group, F.col(c)), F.when(~group, F.col(c))
    sd = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    return df.groupBy(*keys).agg(F.when(sd > 0, (F.avg(a) - F.avg(b)) / sd).otherwise(0.0).alias("d"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if one has no length."""
    mul = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(mul(a, a)) * F.sqrt(mul(b, b))
    return F.when(size > 0, mul(a, b) / size).otherwise(0.0)


def trait_trust(df: DataFrame, session: str, seat: str, traits: str) -> DataFrame:
    """Mean cosine to the other seats of the session, clipped to [0, 1]; 0.5 if alone."""
    other = df.select(session, F.col(seat).alias("_o"), F.col(traits).alias("_t"))
    pair = df.join(other, session).where(F.col(seat) != F.col("_o")).groupBy(session, seat).agg(F.avg(cosine(F.col(traits), F.col("_t"))).alias("_c"))
    return df.select(session, seat).join(pair, [session, seat], "left").select(session, seat, F.least(F.greatest(F.coalesce("_c", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("trust"))


#: Rows of a block of test and of training subjects that meet in one group, and of the slice of it that is worked on at once.
TEST_BLOCK, TRAIN_BLOCK, SLICE = 2048, 4096, 256


def _unit_rows(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the vector: places, vectors and lengths of those without a missing number."""
    a = column.combine_chunks()
    sizes = pc.list_value_length(a).fill_null(-1).to_numpy(zero_copy_only=False)
    flat, out = a.flatten(), {}
    gaps = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
    ends = np.cumsum(np.maximum(sizes, 0))
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == n)
        at = at[gaps[ends[at]] == gaps[ends[at] - n]]
        rows = values[(ends[at] - n)[:, None] + np.arange(n)] if len(at) else np.zeros((0, n))
        out[n] = (at, rows, np.sqrt((rows * rows).sum(axis=1)))
    return out


def weighted_transfer(test: DataFrame, train: DataFrame, stimulus: str, subject: str, traits: str, label: str, floor: float = 0.05) -> DataFrame:
    """Per test subject and stimulus: the mean training label, by trait similarity (at least ``floor``).

    All pairs of a stimulus count. Subjects are dealt to blocks by their hash; each block of test subjects meets each block of
    training subjects in a group of its own, as one product of two matrices, and hands on two sums a test subject.
    """
    vector = lambda c: F.transform(c, lambda v: v.cast("double"))
    t = train.where(F.col(subject).isNotNull()).groupBy(stimulus, subject).agg(F.avg(label).alias("_y"), F.first(traits).alias("_t"))
    t = t.select(F.col(stimulus).alias("_k"), F.col(subject).alias("_s"), F.col("_y").cast("double").alias("_y"), vector("_t").alias("_t"))
    q = test.where(F.col(subject).isNotNull()).select(stimulus, subject, vector(traits).alias("_v"))
    blocks = lambda rows: F.ceil(F.count("*") / rows).cast("int")
    size = q.groupBy(stimulus).agg(blocks(TEST_BLOCK).alias("_tests")).join(t.groupBy(F.col("_k").alias(stimulus)).agg(blocks(TRAIN_BLOCK).alias("_trains")), stimulus)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(size, stimulus).withColumn("_a", F.pmod(F.xxhash64(subject, "_v"), "_tests").cast("int")).withColumn("_b", every("_trains"))
    right = t.join(size.select(F.col(stimulus).alias("_k"), "_tests", "_trains"), "_k").withColumn("_d", F.pmod(F.xxhash64("_s"), "_trains").cast("int")).withColumn("_c", every("_tests"))
    types = dict(test.dtypes)

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return q.select([subject, stimulus]).slice(0, 0).append_column("_wy", pa.array([], pa.float64())).append_column("_w", pa.array([], pa.float64()))
        place = {s: i for i, s in enumerate(t.column("_s").to_pylist())}
        own = np.array([place.get(s, -1) for s in q.column(subject).to_pylist()])
        y = t.column("_y").to_numpy()
        told = ~np.array(t.column("_y").is_null())
        y = np.where(told, y, 0.0)
        a, b = _unit_rows(q.column("_v")), _unit_rows(t.column("_t"))
        wy, w_sum = np.empty(q.num_rows), np.empty(q.num_rows)
        for start in range(0, q.num_rows, SLICE):
            stop = min(start + SLICE, q.num_rows)
            w = np.full((stop - start, t.num_rows), floor)
            for n in a.keys() & b.keys():
                (at, rows, length), (other, vectors, lengths) = a[n], b[n]
                these = (at >= start) & (at < stop)
                if these.any() and len(other):
                    with np.errstate(invalid="ignore", divide="ignore"):
                        both = length[these][:, None] * lengths
                        w[np.ix_(at[these] - start, other)] = np.maximum(np.where(both <= 0, 0.0, rows[these] @ vectors.T / both), floor)
            mine = np.flatnonzero(own[start:stop] >= 0)
            w[mine, own[start:stop][mine]] = 0.0
            wy[start:stop], w_sum[start:stop] = w @ y, w.sum(axis=1)
        met = t.num_rows - (own >= 0) > 0
        rated = told.sum() - np.where(own >= 0, told[own], False) > 0
        out = pa.table([q.column(subject), q.column(stimulus), pa.array(wy, mask=~rated), pa.array(w_sum)], names=[subject, stimulus, "_wy", "_w"])
        return out.filter(pa.array(met))

    met = left.select(stimulus, subject, "_v", "_a", "_b").groupBy(stimulus, "_a", "_b").cogroup(right.select("_k", "_s", "_y", "_t", "_c", "_d").groupBy("_k", "_c", "_d"))
    sums = met.applyInArrow(run, f"{subject} {types[subject]}, {stimulus} {types[stimulus]}, _wy double, _w double")
    return sums.groupBy(subject, stimulus).agg((F.sum("_wy") / F.sum("_w")).alias("label"))
