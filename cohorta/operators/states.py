"""States and results on top of features: biomarkers, quality rows, speaking, synchrony, zones, label sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.scalars import flag_text, flags, mean_of, rating_class, z_label
from cohorta.operators.group import average_ranks, pearson
from cohorta.operators.signals import gaussian_posterior
from cohorta.operators.windows import runs


def biomarkers(df: DataFrame, z: dict[str, str], task: str | None = None) -> DataFrame:
    """Adds load, arousal, attention, decision, recovery and, with a task number, fatigue, and labels of the first three.

    z: the z columns of eda, scr, rate, rmssd, pupil, pupil_sd, missing and valid. Means skip what is missing.
    """
    c = {k: F.col(v) for k, v in z.items()}
    out = df.withColumn("load", mean_of(c["pupil"], c["eda"], -c["rmssd"])).withColumn("arousal", mean_of(c["scr"], c["rate"], c["pupil_sd"]))
    out = out.withColumn("attention", mean_of(c["valid"], -c["missing"], -c["pupil_sd"])).withColumn("decision", mean_of(F.col("arousal"), c["eda"])).withColumn("recovery", mean_of(-c["eda"], -c["rate"], c["rmssd"]))
    if task:
        out = out.withColumn("fatigue", F.when(F.col(task) >= 1, F.col(task) * -c["pupil"] / 4))
    for name in ("load", "arousal", "attention"):
        out = out.withColumn(f"{name}_label", z_label(F.col(name)))
    return out


def signed_index(df: DataFrame, keys: list[str], directions: dict[str, int], least: int = 2) -> DataFrame:
    """keys, n and index: the mean, over features, of the z among all rows times its direction; null below ``least`` features.

    A feature without spread does not count. One aggregation gives all means and spreads.
    """
    s = df.agg(*[f(c).alias(f"_{c}_{n}") for c in directions for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [F.when(F.col(f"_{c}_s") > 0, (F.col(c) - F.col(f"_{c}_m")) / F.col(f"_{c}_s") * d) for c, d in directions.items()]
    n = sum((v.isNotNull().cast("int") for v in z), F.lit(0))
    return df.crossJoin(F.broadcast(s)).select(*keys, n.alias("n"), F.when(n >= least, mean_of(*z)).alias("index"))  # one row of moments


#: Bounds of the quality flags of a physiological feature row.
PHYSIO_BOUNDS = {"rate": (35.0, 220.0), "temp": (20.0, 45.0), "mismatch": 20.0, "moving": 0.2, "device": 0.5, "quality": 0.65, "rmssd": 300.0}


def physio_row(df: DataFrame, least_s: float, least_pct: float, hz: tuple[float, float]) -> DataFrame:
    """Adds heart_rate, its source, hrv (null if unreliable) and qc, the ordered flags of a feature row.

    Takes n, duration_s, hz, ppg_pct, eda_pct, temp_pct, accel_pct, gyro_pct, mag_pct, device_rate,
    device_share, spectral_rate, mismatch, rmssd, quality, temp, temp_aux and moving; null is unknown.
    """
    b, c = PHYSIO_BOUNDS, F.col
    device = (c("device_share") >= b["device"]) & c("device_rate").between(*b["rate"])
    rate = F.when(device, c("device_rate")).otherwise(c("spectral_rate"))
    hrv = F.when((c("quality") >= b["quality"]) & (c("rmssd") <= b["rmssd"]), c("rmssd"))
    known = lambda t: F.coalesce(t, F.lit(False))
    out = df.withColumn("heart_rate", rate).withColumn("source", F.when(device, "device").otherwise("spectral")).withColumn("hrv", hrv)
    found = flags(
        missing_physio=c("n") == 0, short_duration=known(c("duration_s") < least_s), sample_rate_unavailable=c("hz").isNull(), sample_rate_unusual=known(~c("hz").between(*hz)),
        **{f"{k}_low_coverage": known(c(f"{k}_pct") < least_pct) for k in ("ppg", "eda", "temp", "accel", "gyro", "mag")},
        hr_low_coverage=known(c("device_share") < b["device"]), hr_implausible=known(~c("heart_rate").between(*b["rate"])), ppg_hr_mismatch=known(c("mismatch") > b["mismatch"]),
        hrv_unreliable=~known(c("hrv") > 0), temp_implausible=known(~c("temp").between(*b["temp"])), temp_aux_implausible=known(~c("temp_aux").between(*b["temp"])),
        motion_contaminated=known(c("moving") > b["moving"]), eda_phasic_detection_limited=c("hz").isNull() | known(c("eda_pct") < least_pct),
    )
    return out.withColumn("qc", flag_text(found))


def speaking_metrics(frames: DataFrame, keys: list[str], mic: str, frame: str, speaking: str, frame_s: float, pause_s: float = 0.5) -> DataFrame:
    """Per key and microphone: speaking seconds and share, segments, and pauses of ``pause_s`` or more between segments."""
    by = [*keys, mic]
    seg = runs(frames, by, frame, speaking).where("state")
    gap = (F.col("start") - F.lag("end").over(Window.partitionBy(*by).orderBy("start")) - 1) * frame_s
    s = seg.withColumn("_g", gap).groupBy(*by).agg((F.sum("n") * frame_s).alias("speaking_s"), F.count("*").alias("segments"), F.count_if(F.col("_g") >= pause_s - 1e-9).alias("pauses"))
    n = frames.groupBy(*by).agg(F.count("*").alias("_n"))
    out = n.join(s, by, "left").withColumn("speaking_s", F.coalesce("speaking_s", F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*by, "speaking_s", (F.col("speaking_s") / (F.col("_n") * frame_s)).alias("speaking_share"), zero("segments"), zero("pauses"))


def overlap_share(frames: DataFrame, keys: list[str], frame: str, rms: str, floor: float, ratio: float) -> DataFrame:
    """Share of the frames with two microphones or more above the floor in which none is ``ratio`` times the second; 0 without such frames."""
    top = F.slice(F.sort_array(F.collect_list(rms), False), 1, 2)  # a frame has one row a microphone
    f = frames.groupBy(*keys, frame).agg(F.count_if(F.col(rms) > floor).alias("_n"), top.alias("_t"))
    clear = F.get("_t", 0) / F.greatest(F.get("_t", 1), F.lit(floor)) >= ratio
    return f.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("_n") >= 2, (~clear).cast("double"))), F.lit(0.0)).alias("overlap"))


def synchrony(df: DataFrame, keys: list[str], at: str, member: str, value: str) -> DataFrame:
    """Per key: pairs of members, and the mean, population sd and largest of their correlations over common times (0 without spread)."""
    m = df.groupBy(*keys, at, member).agg(F.avg(value).alias("_v"))
    a, b = m.withColumnRenamed(member, "_a").withColumnRenamed("_v", "_x"), m.withColumnRenamed(member, "_b").withColumnRenamed("_v", "_y")
    pair = a.join(b, [*keys, at]).where("_a < _b").groupBy(*keys, "_a", "_b")
    r = pair.agg(F.when((F.stddev_pop("_x") < 1e-8) | (F.stddev_pop("_y") < 1e-8), 0.0).otherwise(F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))).alias("r"))
    return r.groupBy(*keys).agg(F.count("*").alias("pairs"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.max("r").alias("largest"))


def flag_events(df: DataFrame, keys: list[str], order: str, names: list[str]) -> DataFrame:
    """Every maximal run of rows with a flag set: keys, event, start, end (inclusive) and n."""
    long = df.unpivot([*keys, order], names, "event", "_on")
    return runs(long, [*keys, "event"], order, "_on").where("state").drop("state", "run")


def event_summary(events: DataFrame, member: str) -> DataFrame:
    """Events by member, by kind and in all (null stands for all)."""
    return events.groupingSets([[F.col(member)], [F.col("event")], []], F.col(member), F.col("event")).agg(F.count("*").alias("events"), F.sum("n").alias("frames"))


def rank_correlations(df: DataFrame, traits: list[str], ratings: list[str], least: int = 3) -> DataFrame:
    """Spearman of every trait with every rating over rows that have both."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("trait"), F.lit(b).alias("rating"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a in traits for b in ratings])).alias("p")).select("p.*").where("x is not null and y is not null")
    by = ["trait", "rating"]
    return average_ranks(average_ranks(each, "x", by, "_rx"), "y", by, "_ry").groupBy(*by).agg(F.count("*").alias("n"), pearson("_rx", "_ry", least).alias("r"))


def subject_vectors(df: DataFrame, subject: str, task: str, value: str, tasks: list) -> DataFrame:
    """Of each subject the mean value of every task, in order; 0 for a task without values."""
    return df.groupBy(subject).agg(F.array(*[F.coalesce(F.avg(F.when(F.col(task) == t, F.col(value))), F.lit(0.0)) for t in tasks]).alias("vector"))


def results_table(scores: DataFrame, variant: str, fold: str, score: str, folds: list, baseline) -> DataFrame:
    """Per variant: each fold's score, their mean, and the mean's difference to the baseline variant."""
    t = scores.groupBy(variant).agg(*[F.avg(F.when(F.col(fold) == f, F.col(score))).alias(f"fold_{f}") for f in folds], F.avg(score).alias("mean"))
    base = t.where(F.col(variant) == baseline).agg(F.max("mean").alias("_b"))  # one row
    return t.crossJoin(F.broadcast(base)).withColumn("delta", F.col("mean") - F.col("_b")).drop("_b")


def zone_of(x: Column, y: Column, zones: list[tuple]) -> Column:
    """The zone of least priority, then name, that holds a point; ``other`` if none does.

    zones: (name, priority, "circle", cx, cy, radius) or (name, priority, "rect", x0, y0, x1, y1), edges included.
    """
    tests = []
    for name, _, kind, *p in sorted(zones, key=lambda z: (z[1], z[0])):
        inside = (x - p[0]) ** 2 + (y - p[1]) ** 2 <= p[2] ** 2 if kind == "circle" else x.between(min(p[0], p[2]), max(p[0], p[2])) & y.between(min(p[1], p[3]), max(p[1], p[3]))
        tests.append(F.when(inside, F.lit(name)))
    return F.coalesce(*tests, F.lit("other"))


def good_gaze(markers: Column, error: Column, least: int, most_px: float) -> Column:
    return (markers >= least) & (error <= most_px)


def rebased(df: DataFrame, keys: list[str], t: str, above: float = 1000.0) -> DataFrame:
    """Times since the key's first where that is above the bound, else as they are."""
    first = F.min(t).over(Window.partitionBy(*keys))
    return df.withColumn(t, F.when(first > above, F.col(t) - first).otherwise(F.col(t)))


def unit_scaled(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Adds scaled: c moved to 0 .. 1 within its key; 0 where it is constant, null where it is null."""
    m = df.groupBy(*keys).agg(F.min(c).alias("_a"), F.max(c).alias("_z"))
    scaled = F.when(F.col("_z") > F.col("_a"), (F.col(c) - F.col("_a")) / (F.col("_z") - F.col("_a"))).otherwise(F.col(c) * 0.0)
    return df.join(m, keys, "left").withColumn("scaled", scaled).drop("_a", "_z")


def key_order(df: DataFrame, maps: list[str]) -> DataFrame:
    """One row: all keys of the map columns, in order."""
    keys = F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in maps]))))
    return df.select(keys.alias("k")).distinct().agg(F.array_sort(F.collect_list("k")).alias("keys"))


def without_modality(df: DataFrame, modality: str) -> DataFrame:
    """The map column of a modality emptied."""
    return df.withColumn(modality, F.map_filter(modality, lambda k, v: F.lit(False)))


# --- labels -----------------------------------------------------------------------------------


def report_index(df: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Per key the reports in order of time, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("reports"), F.array_sort(F.collect_list(F.struct(at, *values))).alias("series"))


def process_parameters(df: DataFrame, keys: list[str], at: str, c: str, prior: tuple[float, float, float], lags: tuple[float, float] = (5.0, 300.0), step: float = 10.0, least: int = 5) -> DataFrame:
    """One row: rate, variance and mean of a mean-reverting process from consecutive reports.

    log r = -rate * lag is fitted through the origin over lag bins ``step`` wide whose correlation lies
    between 1e-6 and 1 (two pairs at least). The prior (rate, variance, mean) stands in for fewer than ``least`` pairs or
    two bins, and for a rate more than five times off.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    pair = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("x"), F.lead(c).over(w).cast("double").alias("y"), (F.lead(at).over(w) - F.col(at)).cast("double").alias("lag"))
    pair = pair.where((F.col("lag") > lags[0]) & (F.col("lag") < lags[1]))
    # Bins are centred on rounded lags and open at half a step on both sides.
    near = pair.withColumn("bin", F.rint(F.col("lag") / step) * step).where(F.abs(F.col("lag") - F.col("bin")) < step / 2)
    r = near.groupBy("bin").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r")).where("n >= 2 and r > 1e-6 and r < 1")
    fit = r.agg(F.count("*").alias("_bins"), F.greatest(-F.sum(F.col("bin") * F.ln("r")) / F.sum(F.col("bin") ** 2), F.lit(0.01)).alias("_rate"))
    sums = pair.agg(F.count("*").alias("pairs"), ((F.avg("x") + F.avg("y")) / 2).alias("_mean"), ((F.avg(F.col("x") ** 2) + F.avg(F.col("y") ** 2)) / 2).alias("_sq"))
    ok = (F.col("pairs") >= least) & (F.col("_bins") >= 2) & F.col("_rate").between(prior[0] / 5, prior[0] * 5)
    pick = lambda value, p, name: F.when(ok, value).otherwise(p).alias(name)
    both = sums.crossJoin(F.broadcast(fit))  # one row each
    return both.select("pairs", pick(F.col("_rate"), prior[0], "rate"), pick(F.col("_sq") - F.col("_mean") ** 2, prior[1], "variance"), pick(F.col("_mean"), prior[2], "mean"))


def left_out_posterior(df: DataFrame, keys: list[str], at: str, c: str, mean: float, rate: float, sd: float, noise: float) -> DataFrame:
    """keys, t, y, mu and sigma: each report's posterior from all other reports of its key; keys of one report give none.

    The posterior with all reports is found in two passes, and each report's own share is taken off it again.
    """
    types = dict(df.dtypes)

    def run(key, rows):
        rows = rows.dropna(subset=[at, c])
        if len(rows) < 2:
            return pd.DataFrame({k: [] for k in (*keys, "t", "y", "mu", "sigma")})
        t, y = rows[at].to_numpy(float), rows[c].to_numpy(float)
        m, s = gaussian_posterior(t, t, y, np.full(len(t), noise), mean, rate, sd)
        v = 1 / np.maximum(1 / s**2 - 1 / noise**2, 1 / sd**2)
        mu = v * ((m - mean) / s**2 - (y - mean) / noise**2) + mean
        return pd.DataFrame({**dict(zip(keys, key)), "t": t, "y": y, "mu": mu, "sigma": np.sqrt(v)})

    return df.select(*keys, at, c).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", t double, y double, mu double, sigma double")


def left_out_accuracy(posterior: DataFrame, by: list[str], t1: float, t2: float, least: float = 0.05, most: float = 0.9) -> DataFrame:
    """Per key the share of reports whose class the others predict, and the weight floor 1 - share, clipped."""
    hit = F.avg((rating_class(F.col("y"), t1, t2) == rating_class(F.col("mu"), t1, t2)).cast("double"))
    return posterior.groupBy(*by).agg(F.count("*").alias("n"), hit.alias("accuracy")).withColumn("floor", F.least(F.greatest(1 - F.col("accuracy"), F.lit(least)), F.lit(most)))


def rest_baseline(df: DataFrame, seat: list[str], window: str, task: str, value: str, rest) -> DataFrame:
    """Per seat the mean over rest windows of their mean values."""
    w = df.where(F.col(task) == rest).groupBy(*seat, window).agg(F.avg(value).alias("_m"))
    return w.groupBy(*seat).agg(F.avg("_m").alias("baseline"), F.count("_m").alias("windows"))


def trusted(df: DataFrame, trust: DataFrame, keys: list[str], share: str, weight: str, least: float, trust_only: bool = False) -> DataFrame:
    """Rows whose trust, times their weight unless ``trust_only``, and largest class share both reach ``least`` and a half; adds trusted_weight."""
    j = df.join(trust.select(*keys, "trust"), keys)
    w = F.col("trust") if trust_only else F.col("trust") * F.col(weight)
    return j.withColumn("trusted_weight", w).where((F.col("trusted_weight") >= least) & (F.col(share) >= 0.5)).drop("trust")


def overridden(df: DataFrame, better: DataFrame, keys: list[str], value: str, weight: str, task: str, task_weight: dict) -> DataFrame:
    """Value and weight replaced by another source's value with its task's weight; weight 0 where it has none."""
    table = F.create_map(*[F.lit(x) for kv in task_weight.items() for x in kv])
    j = df.join(better.select(*keys, F.col(value).alias("_v")), keys, "left")
    w = F.when(F.col("_v").isNull(), 0.0).otherwise(F.coalesce(F.try_element_at(table, F.col(task)), F.lit(0.0)))
    return j.withColumn(value, F.coalesce("_v", value)).withColumn(weight, w).drop("_v")


def train_scaled(df: DataFrame, role: str, values: list[str]) -> DataFrame:
    """Values less the mean and over the population sd (1 without spread) of the training rows only."""
    mine = lambda c: F.when(F.col(role) == "train", F.col(c))
    s = df.agg(*[f(mine(c)).alias(f"_{c}_{n}") for c in values for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(s))  # one row
    for c in values:
        out = out.withColumn(c, (F.col(c) - F.col(f"_{c}_m")) / F.when(F.col(f"_{c}_s") > 0, F.col(f"_{c}_s")).otherwise(1.0))
    return out.drop(*[f"_{c}_{n}" for c in values for n in "ms"])
