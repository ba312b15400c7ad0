"""Per-group features of signals: one aggregation each, plus quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.scalars import flag_text, flags
from cohorta.operators.windows import velocity


def basic(c: str) -> list[Column]:
    """n, coverage in percent, mean, median, population sd, min, p95, max of the finite values."""
    x = F.col(c)
    return [
        F.count(x).alias("n"), (100.0 * F.count(x) / F.count("*")).alias("coverage"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"),
        F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.percentile(x, F.lit(0.95)).alias("p95"), F.max(x).alias("max"),
    ]


def slope(df: DataFrame, keys: list[str], t: str, c: str, ols: bool = False) -> DataFrame:
    """slope over finite pairs, two at least; null without any spread in time.

    Unless ``ols``, x is measured from its minimum, not its mean, in both sums, as the
    published feature is; ``ols`` gives the least-squares slope.
    """
    ok = df.where(F.col(t).isNotNull() & F.col(c).isNotNull())
    if ols:
        return ok.groupBy(*keys).agg(F.when(F.count("*") >= 2, F.regr_slope(c, t)).alias("slope"))
    w = Window.partitionBy(*keys)
    x, y = F.col(t) - F.min(t).over(w), F.col(c) - F.avg(c).over(w)
    sums = ok.withColumn("_x", x).withColumn("_y", y).groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.col("_x") * F.col("_y")).alias("_xy"), F.sum(F.col("_x") ** 2).alias("_xx"))
    return sums.select(*keys, F.when((F.col("_n") >= 2) & (F.col("_xx") > 0), F.col("_xy") / F.col("_xx")).alias("slope"))


def sample_rate(df: DataFrame, keys: list[str], us: str, least: int = 5) -> DataFrame:
    """1 / median positive step in seconds, of ``least`` timestamps or more."""
    w = Window.partitionBy(*keys).orderBy(us)
    d = df.withColumn("_d", (F.col(us) - F.lag(us).over(w)) / 1e6)
    rate = F.when(F.count(us) >= least, 1 / F.percentile(F.when(F.col("_d") > 0, F.col("_d")), F.lit(0.5)))
    return d.groupBy(*keys).agg(rate.alias("rate_hz"))


def motion(df: DataFrame, keys: list[str], axes: list[str], rate: float, threshold: float) -> DataFrame:
    """Magnitude of a vector and its distance from the group's median times the rate: mean, p95, max.

    Missing axes count 0, so a row without any has magnitude 0.
    """
    mag = F.sqrt(sum((F.coalesce(F.col(a), F.lit(0.0)) ** 2 for a in axes), F.lit(0.0)))
    m = df.withColumn("_m", mag)
    mid = m.groupBy(*keys).agg(F.percentile("_m", F.lit(0.5)).alias("_mid"))
    jerk = F.abs(F.col("_m") - F.col("_mid")) * rate
    return m.join(mid, keys).withColumn("_j", jerk).groupBy(*keys).agg(F.avg("_m").alias("mag_mean"), F.percentile("_m", F.lit(0.95)).alias("mag_p95"), F.max("_m").alias("mag_max"), F.avg("_j").alias("jerk_mean"), F.avg((F.abs(F.col("_m") - F.col("_mid")) > threshold).cast("double")).alias("moving"))


def eye_tracking(df: DataFrame, keys: list[str], us: str, x: str, y: str, valid: str, least_us: int = 5_000_000, least_valid: float = 0.5, bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Valid share, centroid, dispersion, share out of bounds, speeds, duration, and flags."""
    v = velocity(df, keys, us, [x, y], valid)
    ok = F.col(valid)
    out = ~(F.col(x).between(*bounds) & F.col(y).between(*bounds))
    a = v.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(ok.cast("double")).alias("valid_share"), ((F.max(us) - F.min(us)) / 1e6).alias("duration_s"),
        F.avg(F.when(ok, F.col(x))).alias("cx"), F.avg(F.when(ok, F.col(y))).alias("cy"),
        F.sqrt(F.var_pop(F.when(ok, F.col(x))) + F.var_pop(F.when(ok, F.col(y)))).alias("dispersion"),
        F.avg(F.when(ok, out.cast("double"))).alias("out_share"), F.avg("speed").alias("speed_mean"), F.percentile("speed", F.lit(0.95)).alias("speed_p95"),
    )
    found = flags(short=F.col("duration_s") < least_us / 1e6, few_valid=F.col("valid_share") < least_valid, out_of_bounds=F.coalesce(F.col("out_share") > 0.2, F.lit(False)), no_motion=F.col("speed_mean").isNull())
    return a.withColumn("qc", flag_text(found))


def pupil(df: DataFrame, keys: list[str], t: str, left: str, right: str, valid: str) -> DataFrame:
    """Mean, sd, slope of the pair's mean; share missing; mean validity; mean difference of the eyes."""
    both = df.withColumn("_p", F.coalesce((F.col(left) + F.col(right)) / 2, left, right))
    a = both.groupBy(*keys).agg(F.avg("_p").alias("pupil_mean"), F.stddev_pop("_p").alias("pupil_sd"), F.avg(F.col("_p").isNull().cast("double")).alias("missing"), F.avg(F.col(valid).cast("double")).alias("validity"), F.avg(F.col(left) - F.col(right)).alias("asymmetry"))
    return a.join(slope(both, keys, t, "_p"), keys, "left")


def entropy(df: DataFrame, keys: list[str], c: str, bins: int, low: float, high: float) -> DataFrame:
    """Shannon entropy (nats) of a value's histogram; the last bin is closed."""
    b = F.least(F.floor((F.col(c) - low) / ((high - low) / bins)), F.lit(bins - 1))
    n = df.where(F.col(c).between(low, high)).groupBy(*keys, b.alias("_b")).agg(F.count("*").alias("_n"))
    p = F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys))
    return n.withColumn("_p", p).groupBy(*keys).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("entropy"))


def pupil_shape(df: DataFrame, keys: list[str], us: str, c: str) -> DataFrame:
    """Successive differences' RMS, range, mean and sd of the derivative, skewness, excess kurtosis."""
    w = Window.partitionBy(*keys).orderBy(us)
    d = df.where(F.col(c).isNotNull()).withColumn("_d", F.col(c) - F.lag(c).over(w))
    return d.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_d") ** 2)).alias("rmssd"), (F.max(c) - F.min(c)).alias("range"), F.avg("_d").alias("d_mean"), F.stddev_pop("_d").alias("d_sd"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"))


def levels(frames: DataFrame, keys: list[str], sum_sq: str, n: str) -> DataFrame:
    """From a table of frame energies: mean, median, sd, max of RMS, and the mean in decibels."""
    rms = F.sqrt(F.col(sum_sq) / F.col(n))
    a = frames.where(F.col(n) > 0).withColumn("_r", rms).groupBy(*keys).agg(F.avg("_r").alias("rms_mean"), F.percentile("_r", F.lit(0.5)).alias("rms_median"), F.stddev_pop("_r").alias("rms_sd"), F.max("_r").alias("rms_max"))
    return a.withColumn("db_mean", F.greatest(20 * F.log10(F.greatest(F.col("rms_mean"), F.lit(1e-10))), F.lit(-80.0)))


def dominant(frames: DataFrame, keys: list[str], frame: str, mic: str, rms: str, floor: float, ratio: float) -> DataFrame:
    """Adds speaking: louder than the floor and ``ratio`` times as loud as the loudest other microphone."""
    w = Window.partitionBy(*keys, frame)
    top = F.max(F.struct(rms, mic)).over(w)
    ranked = F.sort_array(F.collect_list(rms).over(w), False)
    other = F.when(top[mic] == F.col(mic), F.coalesce(F.get(ranked, 1), F.lit(0.0))).otherwise(top[rms])
    return frames.withColumn("speaking", (F.col(rms) > floor) & (F.col(rms) >= ratio * other))


def turns(segments: DataFrame, session: str, order: list[str], speaker: str) -> DataFrame:
    """Per session and speaker: segments, and turns, which follow another speaker's segment."""
    before = F.lag(speaker).over(Window.partitionBy(session).orderBy(*order))
    return segments.withColumn("_turn", (before != F.col(speaker)).cast("int")).groupBy(session, speaker).agg(F.count("*").alias("segments"), F.coalesce(F.sum("_turn"), F.lit(0)).alias("turns"))


def best_channel(df: DataFrame, keys: list[str], channel: str, quality: str) -> DataFrame:
    """The channel of highest quality; the first one wins a tie."""
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(quality).alias("quality"), (-F.col(channel)).alias("_c"))).alias("_b")).select(*keys, (-F.col("_b._c")).alias("channel"), F.col("_b.quality").alias("quality"))
