"""Labels and predictions from features, and what repairs a track or a clock before them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.scalars import soft_label
from cohorta.operators.joins import nearest


def knn_labels(pool: DataFrame, labelled: DataFrame, key: str, features: list[str], label: str, k: int = 7, most: int = 20_000) -> DataFrame:
    """Adds label and confidence: the class of most weight among the k nearest labelled rows, and its share.

    Distances are Euclidean in features standardised by the labelled rows; a weight is 1 / distance, and
    rows at distance 0, if there are any, are the only ones that count. Ties in distance go to the
    smaller key, ties in weight to the smaller label. Labelled rows with a missing value do not count;
    pool rows with one, and all if there are fewer than k + 1 labelled rows, get null. The labelled rows
    are broadcast in one row; more than ``most`` are refused.
    """
    whole = labelled.dropna(subset=[*features, label])
    n = whole.count()
    if n > most:
        raise ValueError(f"{n} labelled rows are more than the {most} that may be broadcast")
    s = whole.agg(*[f(c).alias(f"_{c}_{m}") for c in features for m, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = lambda c: (F.col(c) - F.col(f"_{c}_m")) / F.when(F.col(f"_{c}_s") > 0, F.col(f"_{c}_s")).otherwise(1.0)
    z = F.array(*[scaled(c) for c in features])
    known = whole.crossJoin(F.broadcast(s)).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(label).alias("y"), z.alias("z"))).alias("_known"))  # at most `most` rows
    rows = pool.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(known)).withColumn("_z", z)
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)
    near = F.slice(F.array_sort(F.transform("_known", lambda r: F.struct(F.sqrt(square(r["z"], F.col("_z"))).alias("d"), r["k"].alias("k"), r["y"].alias("y")))), 1, k)
    rows = rows.withColumn("_near", near).withColumn("_hit", F.get("_near", 0)["d"] == 0)
    weight = lambda r: F.when(F.col("_hit"), (r["d"] == 0).cast("double")).otherwise(1 / r["d"])
    votes = F.transform("_near", lambda r: F.struct(r["y"].alias("y"), weight(r).alias("w")))
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda t, v: t + f(v))
    classes = F.transform(F.array_sort(F.array_distinct(F.transform("_votes", lambda v: v["y"]))), lambda y: F.struct(y.alias("y"), add(F.filter("_votes", lambda v: v["y"] == y), lambda v: v["w"]).alias("w")))
    best = F.reduce("_c", F.get("_c", 0), lambda a, b: F.when(b["w"] > a["w"], b).otherwise(a))
    rows = rows.withColumn("_votes", votes).withColumn("_c", classes).withColumn("_b", best)
    ok = F.lit(n > k)
    for c in features:
        ok &= F.col(c).isNotNull()
    return rows.select(*[pool[c] for c in pool.columns], F.when(ok, F.col("_b.y")).alias("label"), F.when(ok, F.col("_b.w") / add(F.col("_votes"), lambda v: v["w"])).alias("confidence"))


def rate_direction(df: DataFrame, keys: list[str], index: str, value: str, hz: float, bin_s: float = 5.0, least_sd: float = 0.5) -> DataFrame:
    """keys, bin, center_s and shift of each whole bin: its slope a sample, over -5, within 1.5 either way.

    ``index`` counts a window's samples from 0. Missing values take the last one before, or 0; windows
    that vary less than ``least_sd`` and bins of fewer than three samples give no rows.
    """
    size = max(1, int(hz * bin_s))
    w = Window.partitionBy(*keys)
    seen = F.coalesce(F.last(value, True).over(w.orderBy(index).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    x = df.withColumn("_x", seen).withColumn("_sd", F.stddev_pop("_x").over(w)).withColumn("bin", F.floor(F.col(index) / size))
    b = x.where(F.col("_sd") >= least_sd).groupBy(*keys, "bin").agg(F.count("*").alias("_n"), F.regr_slope("_x", index).alias("_slope"))
    shift = F.greatest(F.lit(-1.5), F.least(F.lit(1.5), -F.col("_slope") / 5))
    return b.where((F.col("_n") == size) & (F.col("_n") >= 3)).select(*keys, "bin", ((F.col("bin") + 0.5) * bin_s).alias("center_s"), shift.alias("shift"))


def highest_peaks(x: np.ndarray, distance: int, height: float) -> list[int]:
    """Middles of the local maxima of ``height`` or more; of two nearer than ``distance`` the higher stays, of equal ones the later."""
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if j + 1 < len(x) and x[i - 1] < x[i] > x[j + 1] and x[i] >= height:
            found.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


def response_events(df: DataFrame, trace: str, baseline: str, start: str, hz: float, height: float = 0.05, apart_s: float = 1.0, latency_s: float = 2.5) -> DataFrame:
    """One row for each skin-conductance response of a row's trace: at (its peak less the latency) and amplitude above the baseline.

    ``trace`` is an array of one window; missing values are 0 before the baseline is taken off.
    """

    @F.pandas_udf("array<struct<at: double, amplitude: double>>")
    def events(x: pd.Series, base: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for v, b, t in zip(x, base, at):
            y = np.nan_to_num(np.asarray([] if v is None else v, float)) - b
            out.append([{"at": t + p / hz - latency_s, "amplitude": float(y[p])} for p in highest_peaks(y, max(1, int(hz * apart_s)), height)])
        return pd.Series(out)

    rest = [c for c in df.columns if c != trace]
    found = df.select(*rest, F.explode(events(F.col(trace), F.coalesce(F.col(baseline), F.lit(0.0)), F.col(start).cast("double"))).alias("_e"))
    return found.select(*rest, F.col("_e.at").alias("at"), F.col("_e.amplitude").alias("amplitude"))


def too_fast(df: DataFrame, keys: list[str], frame: str, coords: list[str], most: float) -> DataFrame:
    """Adds rejected: the later point of a step above ``most`` a frame between valid points.

    Steps are those of the points as given. The step from a rejected point is not judged, so of
    steps in a row that are all too fast every second one rejects. Points without coordinates are not valid.
    """
    valid = F.col(coords[0]).isNotNull()
    w = Window.partitionBy(*keys, "_valid").orderBy(frame)
    far = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in coords), F.lit(0.0))) / (F.col(frame) - F.lag(frame).over(w))
    d = df.withColumn("_valid", valid).withColumn("_fast", F.col("_valid") & F.coalesce(far > most, F.lit(False))).withColumn("_i", F.row_number().over(w))
    slow = F.max(F.when(~F.col("_fast"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("rejected", F.col("_fast") & ((F.col("_i") - slow) % 2 == 1)).drop("_valid", "_fast", "_i")


def start_delta(raw: DataFrame, live: DataFrame, keys: list[str], at: str, x: str, y: str, steps: int, step, least: int = 20, first: int | None = None) -> DataFrame:
    """keys, delta and rmse: the shift of ``live`` back by steps of ``step`` after which its points lie nearest to ``raw`` at the nearest times.

    Keys with fewer than ``least`` points on a side give no rows; of equal errors the smallest shift stands.
    ``first`` keeps only the earliest points of a key, where only the beginning shall be matched.
    """
    n = raw.groupBy(*keys).agg(F.count("*").alias("_r")).join(live.groupBy(*keys).agg(F.count("*").alias("_l")), keys).where((F.col("_r") >= least) & (F.col("_l") >= least)).select(*keys)
    if first:
        live = live.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(at, x, y))).where(F.col("_k") <= first).drop("_k")
    asked = live.join(n, keys).withColumn("_d", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
    asked = asked.select(*keys, "_d", (F.col(at) - F.col("_d") * step).alias(at), F.col(x).alias("_x"), F.col(y).alias("_y"))
    near = nearest(asked, raw.select(*keys, at, F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("_p")), keys, at, "_p")
    square = (F.col("near_value.x") - F.col("_x")) ** 2 + (F.col("near_value.y") - F.col("_y")) ** 2
    each = near.groupBy(*keys, "_d").agg(F.sqrt(F.avg(square)).alias("rmse"))
    best = each.groupBy(*keys).agg(F.min_by(F.struct("_d", "rmse"), F.struct(F.round("rmse", 12), "_d")).alias("_b"))
    return best.select(*keys, (F.col("_b._d") * step).alias("delta"), F.col("_b.rmse").alias("rmse"))


def _moments(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    pairs = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"{i}") for i, c in enumerate(columns)], *pairs)


def _ridge(n: float, s: np.ndarray, q: np.ndarray, alpha: float):
    """Mean and sd of the features, inverse of the penalised Gram matrix, weights and intercept, from moments whose last column is the target."""
    mean = s / n
    c = q - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c)[:-1] / n, 0))
    sd[sd <= 1e-9] = 1.0
    inverse = np.linalg.inv(c[:-1, :-1] / np.outer(sd, sd) + alpha * np.eye(len(sd)))
    return mean[:-1], sd, inverse, inverse @ (c[:-1, -1] / sd), mean[-1], n


def left_out_ridge(df: DataFrame, fold: str, features: list[str], target: str, alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0, 500.0), most: int = 1_000) -> DataFrame:
    """Adds predicted, by a ridge model on standardised features of all other folds; rows with a missing value go.

    Each fold's penalty has the least leave-one-out error over its training rows. Moments of a fold are
    totals less its own, so no row is copied; they are all that reaches the driver, for at most ``most`` folds.
    Folds with fewer than two rows outside get null.
    """
    columns = [*features, target]
    d = df.dropna(subset=[fold, *columns])
    center = d.agg(*[F.avg(c).alias(c) for c in columns]).first()
    if center[target] is None:
        return d.withColumn("predicted", F.lit(None).cast("double"))
    moved = d.select(fold, *[(F.col(c) - center[c]).alias(c) for c in columns])
    rows = _moments(moved, [fold], columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} folds")
    p = len(columns)
    own = {r[fold]: (r["n"], np.array([r[f"{i}"] for i in range(p)]), np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])) for r in rows}
    total = [sum(o[i] for o in own.values()) for i in range(3)]
    models = {f: [_ridge(*(t - v for t, v in zip(total, o)), a) for a in alphas] for f, o in own.items() if total[0] - o[0] >= 2}
    shift = np.array([center[c] for c in columns])

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        add = {}
        for b in batches:
            v, f = b[columns].to_numpy(float) - shift, b[fold].to_numpy()
            for k, each in models.items():
                other = v[f != k]
                for i, (mean, sd, inverse, w, m, n) in enumerate(each):
                    z = (other[:, :-1] - mean) / sd
                    h = np.einsum("ij,jk,ik->i", z, inverse, z) + 1 / n
                    add[k, i] = add.get((k, i), 0.0) + float((((other[:, -1] - m - z @ w) / np.maximum(1 - h, 1e-9)) ** 2).sum())
        yield pd.DataFrame([(k, i, e) for (k, i), e in add.items()], columns=["fold", "alpha", "error"])

    kind = dict(d.dtypes)[fold]
    sums = d.select(fold, *columns).mapInPandas(errors, f"fold {kind}, alpha int, error double").groupBy("fold", "alpha").agg(F.sum("error").alias("error"))
    chosen = {r["fold"]: models[r["fold"]][r["alpha"]] for r in sums.groupBy("fold").agg(F.min_by("alpha", F.struct("error", "alpha")).alias("alpha")).collect()}

    # A fold's model is linear, so its prediction is one dot product on the JVM side.
    line = {f: (w / sd, m - mean @ (w / sd) - shift[:-1] @ (w / sd) + shift[-1]) for f, (mean, sd, _, w, m, _) in chosen.items()}
    table = d.sparkSession.createDataFrame([(f, [float(x) for x in w], float(b)) for f, (w, b) in line.items()], f"`{fold}` {kind}, _w array<double>, _b double")
    dot = sum((F.col(c) * F.get("_w", i) for i, c in enumerate(features)), F.col("_b"))
    return d.join(F.broadcast(table), fold, "left").withColumn("predicted", dot).drop("_w", "_b")  # at most `most` folds


def regression_scores(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """One row: n, r2 (null without spread), r (0 without spread of the target) and mae."""
    y, p = F.col(target), F.col(predicted)
    d = df.where(y.isNotNull() & p.isNotNull())
    r2 = 1 - F.try_divide(F.avg((y - p) ** 2), F.var_pop(y))
    return d.agg(F.count("*").alias("n"), r2.alias("r2"), F.when(F.stddev_pop(y) > 1e-6, F.try_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p))).otherwise(0.0).alias("r"), F.avg(F.abs(y - p)).alias("mae"))


def robust_ridge(train: DataFrame, rows: DataFrame, features: list[str], target: str, alpha: float = 1.0, low: float = 1.0, high: float = 9.0) -> DataFrame:
    """Adds predicted to rows: ridge on features less their median, over their quartile range, kept within low and high.

    Training rows with a missing value do not count, rows with one get null; without training rows all do.
    Only one row of moments reaches the driver.
    """
    t = train.dropna(subset=[*features, target])
    q = t.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in features], F.count("*").alias("_n")).first()
    if not q["_n"]:
        return rows.withColumn("predicted", F.lit(None).cast("double"))
    scale = {c: (q[c][1], (q[c][2] - q[c][0]) or 1.0) for c in features}
    z = [((F.col(c) - m) / s).alias(c) for c, (m, s) in scale.items()]
    columns = [*features, target]
    r, p = _moments(t.select(*z, target), [], columns).first(), len(columns)
    n, s = r["n"], np.array([r[f"{i}"] for i in range(p)], float)
    c = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float) - np.outer(s, s) / n
    w = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(p - 1), c[:-1, -1])
    b = (s[-1] - w @ s[:-1]) / n
    line = sum(((F.col(f) - m) / sd * float(k) for k, (f, (m, sd)) in zip(w, scale.items())), F.lit(float(b)))
    return rows.withColumn("predicted", F.when(line.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), line))))


def rebinned(df: DataFrame, mu: str, sigma: str, t1: float, t2: float) -> DataFrame:
    """Adds soft, the posterior's mass in the classes of new thresholds, and hard, the class of most mass (of equal ones the lowest)."""
    d = df.withColumn("soft", soft_label(F.col(mu), F.col(sigma), t1, t2))
    return d.withColumn("hard", F.when(F.col("soft").isNotNull(), (F.array_position("soft", F.array_max("soft")) - 1).cast("int")))
