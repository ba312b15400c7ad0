"""Gaze and pupil of one window: scan path, saccades, fixations, where the eye dwells, blinks, slow and fast change."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _entropy(df: DataFrame, keys: list[str], bins: list[str], name: str) -> DataFrame:
    """Shannon entropy (nats) of the rows' bins, null bins left out."""
    n = df.where(" and ".join(f"{b} is not null" for b in bins)).groupBy(*keys, *bins).agg(F.count("*").alias("_n"))
    p = F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys))
    return n.withColumn("_p", p).groupBy(*keys).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias(name))


def gaze_features(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, valid: str, rate: float, threshold: float | None = None, bins: int = 10, least: int = 5) -> DataFrame:
    """One row a key: shares, means, saccades, fixations, scan path, entropies, transitions and dwell of its valid samples.

    Speeds are steps between valid samples times the rate; those above ``threshold`` (0.1, below 20 Hz 0.03) are saccades, runs of
    three samples or more that are reached more slowly are fixations (the first sample begins one). Entropies are over ``bins``
    equal parts of 0 .. 1 on each axis, the last closed, values outside left out. Quadrant 1 has x and y of 0.5 or
    less, 2 greater y, 3 greater x, 4 both. Fewer than ``least`` valid samples give validity only.
    """
    threshold = threshold if threshold is not None else 0.03 if rate < 20 else 0.1
    ok = F.coalesce(F.col(valid), F.lit(False)) & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    whole = df.groupBy(*keys).agg(F.count("*").alias("_all"), F.avg(ok.cast("double")).alias("validity"))
    w = Window.partitionBy(*keys).orderBy(*order)
    v = df.where(ok).select(*keys, *order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    v = v.withColumn("_d", F.sqrt((F.col("_x") - F.lag("_x").over(w)) ** 2 + (F.col("_y") - F.lag("_y").over(w)) ** 2)).withColumn("_v", F.col("_d") * rate)
    v = v.withColumn("_q", (F.col("_x") > 0.5).cast("int") * 2 + (F.col("_y") > 0.5).cast("int")).withColumn("_turn", (F.col("_q") != F.lag("_q").over(w)).cast("int"))
    v = v.withColumn("_fix", F.coalesce(F.col("_v") < threshold, F.lit(True))).withColumn("_i", F.row_number().over(w))
    v = v.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "_fix").orderBy("_i")))
    cell = lambda c: F.when(F.col(c).between(0, 1), F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)))
    v = v.withColumn("_bx", cell("_x")).withColumn("_by", cell("_y"))
    fast = F.col("_v") > threshold
    a = v.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg("_x").alias("x_mean"), F.stddev_pop("_x").alias("x_sd"), F.avg("_y").alias("y_mean"), F.stddev_pop("_y").alias("y_sd"), F.count_if(fast).alias("saccades"),
        F.coalesce(F.avg(F.when(fast, F.col("_d"))), F.lit(0.0)).alias("saccade_size"), F.coalesce(F.avg(F.when(fast, F.col("_v"))), F.lit(0.0)).alias("saccade_speed"), F.sum("_d").alias("path"),
        F.coalesce(F.sum("_turn"), F.lit(0)).alias("_turns"), *[F.avg((F.col("_q") == q).cast("double")).alias(f"dwell_{q + 1}") for q in range(4)],
    )
    runs = v.where("_fix").groupBy(*keys, "_run").agg(F.count("*").alias("_m"), (F.max("_x") - F.min("_x") + F.max("_y") - F.min("_y")).alias("_spread")).where("_m >= 3")
    f = runs.groupBy(*keys).agg(F.count("*").alias("fixations"), (F.avg("_m") / rate * 1000).alias("fixation_ms"), (F.stddev_pop("_m") / rate * 1000).alias("fixation_ms_sd"), F.avg("_spread").alias("fixation_spread"))
    out = whole.join(a, keys, "left").join(f, keys, "left")
    for b, name in ((["_bx"], "entropy_x"), (["_by"], "entropy_y"), (["_bx", "_by"], "entropy_2d")):
        out = out.join(_entropy(v, keys, b, name), keys, "left")
    enough = F.coalesce(F.col("_n") >= least, F.lit(False))
    seconds = F.greatest(F.col("_all") / rate, F.lit(0.1))
    zero = ("entropy_x", "entropy_y", "entropy_2d", "fixations")
    figures = [c for c in a.columns if c not in (*keys, "_n", "_turns")] + ["fixations", "fixation_ms", "fixation_ms_sd", "fixation_spread", "entropy_x", "entropy_y", "entropy_2d"]
    kept = [F.when(enough, F.coalesce(F.col(c), F.lit(0)) if c in zero else F.col(c)).alias(c) for c in figures]
    return out.select(*keys, "validity", *kept, F.when(enough, F.col("_turns") / seconds).alias("transitions_s"))


def hull_areas(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys and the area of the convex hull of the points; a batch sends on the corners of its own hulls only, so a key may have any size.

    After that a task goes through its keys in order, batch by batch, and holds the corners of one unfinished key.
    """
    types = dict(df.dtypes)
    k = len(keys)

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        code = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns[:k]:
            own = c.dictionary_encode("encode").indices.to_numpy()
            code = np.unique(code * (own.max() + 1) + own, return_inverse=True)[1]
        return code

    def points(batch):
        return (batch.column(k + i).to_numpy(zero_copy_only=False) for i in range(2))

    def corners(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.take(pa.array(_hulls(codes(batch), *points(batch))[0]))

    def areas(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            last = batch is None
            rows = held if last else batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if rows is None:
                return
            code = codes(rows)
            kept, area = _hulls(code, *points(rows))
            done = np.ones(rows.num_rows, bool) if last else code != code[-1]
            held = None if last else rows.take(pa.array(kept[~done[kept]]))
            first = np.flatnonzero(done)
            first = first[np.unique(code[first], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([*rows.take(pa.array(first)).columns[:k], pa.array(area[code[first]])], names=[*keys, "area"])

    own = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    dealt = own.mapInArrow(corners, own.schema).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(areas, ", ".join(f"{c} {types[c]}" for c in keys) + ", area double")


def _hulls(code: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the corners of all keys, in order, and the area by key, by monotone chains over all keys in one pass.

    Points without both coordinates are none, but one row a key at least stays.
    """
    n = int(code.max()) + 1
    area, good = np.zeros(n), np.isfinite(x) & np.isfinite(y)
    count = np.bincount(code[good], minlength=n)
    bare = np.flatnonzero(count[code] == 0)
    few = np.flatnonzero(good & (count[code] < 3))
    order = np.flatnonzero(good & (count[code] >= 3))
    order = order[np.lexsort((y[order], x[order], code[order]))]
    kept: list[int] = [*bare[np.unique(code[bare], return_index=True)[1]].tolist(), *few.tolist()]
    cs, xs, ys = code[order].tolist(), x[order].tolist(), y[order].tolist()
    below: list[int] = []
    above: list[int] = []

    def close():
        size = 0.0
        for chain, sign in ((above, 0.5), (below, -0.5)):
            for a, b in itertools.pairwise(chain):
                size += sign * (xs[b] - xs[a]) * (ys[a] - ys[below[0]] + ys[b] - ys[below[0]])
        area[cs[below[0]]] = size
        kept.extend(order[list({*below, *above})].tolist())

    for i, (c, a, b) in enumerate(zip(cs, xs, ys)):
        if below and c != cs[below[0]]:
            close()
            below, above = [], []
        while len(below) > 1 and (xs[below[-1]] - xs[below[-2]]) * (b - ys[below[-2]]) <= (ys[below[-1]] - ys[below[-2]]) * (a - xs[below[-2]]):
            below.pop()
        below.append(i)
        while len(above) > 1 and (xs[above[-1]] - xs[above[-2]]) * (b - ys[above[-2]]) >= (ys[above[-1]] - ys[above[-2]]) * (a - xs[above[-2]]):
            above.pop()
        above.append(i)
    if below:
        close()
    return np.sort(np.array(kept, np.int64)), area


def fast_share(values: Column) -> Column:
    """Mean square of what a cubic fitted to each 21 values in a row leaves, over that of the fit; null for 20 values or fewer.

    Each value is fitted by the 21 around it, the first and last ten by the first and last 21.
    """
    reach = 10
    t = np.arange(-reach, reach + 1, dtype=float)[:, None] ** np.arange(4)
    fit = t @ np.linalg.pinv(t)  # row i: the weights of 21 values for the fitted value i

    @F.pandas_udf(T.DoubleType())
    def share(column: pd.Series) -> pd.Series:
        out = []
        for v in column:
            v = np.asarray([] if v is None else v, float)
            if len(v) <= 2 * reach:
                out.append(None)
                continue
            slow = np.concatenate((fit[:reach] @ v[: 2 * reach + 1], np.convolve(v, fit[reach][::-1], "valid"), fit[reach + 1 :] @ v[-2 * reach - 1 :]))
            out.append(float(((v - slow) ** 2).mean() / ((slow**2).mean() + 1e-8)))
        return pd.Series(out, dtype=object)

    return share(values)


def pupil_features(df: DataFrame, keys: list[str], order: list[str], left: str, right: str, valid: str, rate: float, bounds: tuple[float, float] = (0.5, 10.0), least: int = 10) -> DataFrame:
    """One row a key (one window): both eyes, their mean, blinks, change, and the share of fast change.

    A sample counts if it is valid and its left eye within the bounds, open; the mean of both eyes is taken where the right
    one is so in all of these, else the left alone. Blinks are runs of other samples. Fewer than ``least`` samples that count give nulls.
    """
    inside = lambda c: F.coalesce((F.col(c) > bounds[0]) & (F.col(c) < bounds[1]), F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order)
    s = df.withColumn("_ok", F.coalesce(F.col(valid), F.lit(False)) & inside(left)).withColumn("_rok", F.col("_ok") & inside(right)).withColumn("_i", F.row_number().over(w))
    s = s.withColumn("_both", F.min(F.when(F.col("_ok"), F.col("_rok"))).over(Window.partitionBy(*keys)))
    mean = F.when(F.col("_both"), (F.col(left) + F.col(right)) / 2).otherwise(F.col(left))
    v = s.where("_ok").withColumn("_p", mean).withColumn("_d", F.col("_p") - F.lag("_p").over(w)).withColumn("_t", F.row_number().over(w))
    rv = F.when(F.col("_rok"), F.col(right))
    a = v.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg(left).alias("left_mean"), F.stddev_pop(left).alias("left_sd"), F.avg(rv).alias("right_mean"), F.stddev_pop(rv).alias("right_sd"), F.avg("_p").alias("pupil_mean"), F.stddev_pop("_p").alias("pupil_sd"),
        F.percentile("_p", F.lit(0.5)).alias("pupil_median"), F.sqrt(F.avg(F.col("_d") ** 2)).alias("rmssd"), F.regr_slope("_p", "_t").alias("slope"), (F.max("_p") - F.min("_p")).alias("range"),
        (F.avg(F.abs("_d")) * rate).alias("change_mean"), (F.stddev_pop("_d") * rate).alias("change_sd"), F.skewness("_p").alias("skewness"), F.kurtosis("_p").alias("kurtosis"),
        F.array_sort(F.collect_list(F.struct("_t", "_p"))).alias("_values"),
    )
    runs = s.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "_ok").orderBy("_i"))).where("not _ok").groupBy(*keys, "_run").agg(F.min("_i").alias("_a"), F.max("_i").alias("_z"))
    runs = runs.withColumn("_since", F.col("_a") - F.lag("_z").over(Window.partitionBy(*keys).orderBy("_a")) - 1)
    b = runs.groupBy(*keys).agg(F.count("*").alias("_blinks"), (F.avg(F.col("_z") - F.col("_a") + 1) / rate * 1000).alias("blink_ms"), (F.avg("_since") / rate).alias("between_blinks_s"))
    n = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    out = n.join(a, keys, "left").join(b, keys, "left")
    enough = F.coalesce(F.col("_n") >= least, F.lit(False))
    figures = [c for c in a.columns if c not in (*keys, "_n", "_values")]
    return out.select(
        *keys, *[F.when(enough, F.col(c)).alias(c) for c in figures], F.when(enough, fast_share(F.col("_values._p"))).alias("fast_share"),
        F.when(enough, F.coalesce("_blinks", F.lit(0)) / F.greatest(F.col("_all") / rate, F.lit(0.1))).alias("blinks_s"), F.when(enough, F.coalesce("blink_ms", F.lit(0.0))).alias("blink_ms"), F.when(enough, F.col("between_blinks_s")).alias("between_blinks_s"),
    )
