"""Clocks: linear and piecewise fits, drift, offsets, spreads, frame and progress checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.operators.group import correlation


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str, flat: float = 1.0) -> DataFrame:
    """scale, offset and mean absolute residual of y on x; without spread scale 1, offset mean(y) - mean(x).

    Two rows and more without spread (all x equal) have the scale ``flat``.
    x is centred on its mean first: clocks are large numbers with small differences.
    """
    m = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count("*").alias("n"))
    c = df.join(m, keys).withColumn("_x", F.col(x) - F.col("_mx")).withColumn("_y", F.col(y) - F.col("_my"))
    s = c.groupBy(*keys, "n", "_mx", "_my").agg(F.sum(F.col("_x") * F.col("_y")).alias("_xy"), F.sum(F.col("_x") ** 2).alias("_xx"), (F.max(x) > F.min(x)).alias("_wide"))
    fit = s.withColumn("scale", F.when(F.col("_wide") & (F.col("_xx") > 0), F.col("_xy") / F.col("_xx")).when(F.col("n") > 1, F.lit(flat)).otherwise(1.0))
    r = c.join(fit.select(*keys, "scale"), keys).groupBy(*keys).agg(F.avg(F.abs(F.col("_y") - F.col("scale") * F.col("_x"))).alias("residual"))
    return fit.withColumn("offset", F.col("_my") - F.col("scale") * F.col("_mx")).select(*keys, "n", "scale", "offset").join(r, keys)


def piecewise_fit(df: DataFrame, keys: list[str], x: str, y: str, points: int, most_residual: float, least: int | None = None, flat: float = 1.0) -> DataFrame:
    """One line, or, where its residual is above the bound and there are points for two, one per ``points`` rows.

    ``least`` is the number of rows from which a key is cut, if not those of two lines; ``flat`` is as in ``linear_fit``.
    Gives segment, start, scale, offset, residual and drift_ppm of the key's first segment.
    """
    whole = linear_fit(df, keys, x, y, flat)
    poor = whole.where((F.col("residual") > most_residual) & (F.col("n") >= (2 * points if least is None else least))).select(*keys)
    seg = df.withColumn("segment", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(x)) - 1) / points))
    cut = seg.join(poor, keys, "left_semi")
    parts = linear_fit(cut, [*keys, "segment"], x, y, flat).join(cut.groupBy(*keys, "segment").agg(F.min(x).alias("start")), [*keys, "segment"])
    one = whole.join(poor, keys, "left_anti").withColumn("segment", F.lit(0).cast("long")).join(df.groupBy(*keys).agg(F.min(x).alias("start")), keys)
    out = parts.unionByName(one.select(*parts.columns))
    return out.withColumn("drift_ppm", (F.first("scale").over(Window.partitionBy(*keys).orderBy("segment")) - 1) * 1e6)


def delay(df: DataFrame, keys: list[str], clock: str, media: str) -> DataFrame:
    """Delays about the median of clock - media: MAD, p5, p95, slope in ms a minute, offset advised."""
    d = df.withColumn("_d", F.col(clock) - F.col(media))
    m = d.groupBy(*keys).agg(F.percentile("_d", F.lit(0.5)).alias("anchor"), F.min(clock).alias("_c0"))
    e = d.join(m, keys).withColumn("_e", F.col("_d") - F.col("anchor")).withColumn("_t", F.col(clock) - F.col("_c0"))
    return e.groupBy(*keys, "anchor").agg(F.count("*").alias("n"), F.percentile(F.abs(F.col("_e")), F.lit(0.5)).alias("mad"), F.percentile("_e", F.lit(0.05)).alias("p5"), F.percentile("_e", F.lit(0.95)).alias("p95"), (F.regr_slope("_e", "_t") * 60_000).alias("drift_ms_min")).withColumn("offset", -F.col("anchor"))


def drift_anchor(df: DataFrame, keys: list[str], clock: str, media: str, least: int = 10, line: int = 20) -> DataFrame:
    """clock - media as a line in the clock; fewer than ``line`` points: their median; than ``least``: no row."""
    d = df.withColumn("_d", F.col(clock) - F.col(media))
    m = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min(clock).alias("clock0"), F.percentile("_d", F.lit(0.5)).alias("_mid")).where(F.col("n") >= least)
    e = d.join(m, keys).withColumn("_t", F.col(clock) - F.col("clock0"))
    f = e.groupBy(*keys, "n", "clock0", "_mid").agg(F.regr_slope("_d", "_t").alias("_s"), F.regr_intercept("_d", "_t").alias("_i"))
    f = f.withColumn("slope", F.when(F.col("n") >= line, F.col("_s")).otherwise(0.0)).withColumn("base", F.when(F.col("n") >= line, F.col("_i")).otherwise(F.col("_mid")))
    r = e.join(f.select(*keys, "slope", "base"), keys).groupBy(*keys).agg(F.sqrt(F.avg((F.col("_d") - F.col("base") - F.col("slope") * F.col("_t")) ** 2)).alias("rmse"))
    return f.select(*keys, "n", "clock0", "slope", "base").join(r, keys)


def better_anchor(first: DataFrame, second: DataFrame, keys: list[str], error: str = "rmse") -> DataFrame:
    """Of two sources the row with the smaller error by key; the first source wins a tie."""
    both = first.withColumn("source", F.lit(1)).unionByName(second.withColumn("source", F.lit(2)))
    w = Window.partitionBy(*keys).orderBy(error, "source")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def feed_offsets(df: DataFrame, feed: str, projected: str, most: float = 5.0, least: int = 2) -> DataFrame:
    """Median of the feeds' medians less each feed's own, 3 decimals; large ones and lone feeds go."""
    own = df.groupBy(feed).agg(F.percentile(projected, F.lit(0.5)).alias("_m"))
    all_ = own.agg(F.percentile("_m", F.lit(0.5)).alias("_all"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return own.crossJoin(F.broadcast(all_)).select(feed, F.round(F.col("_all") - F.col("_m"), 3).alias("offset_s")).where(F.abs("offset_s") <= most)


def envelope_lag(df: DataFrame, keys: list[str], bucket: str, a: str, b: str, most: int, least: int = 20, floor: float = -0.5) -> DataFrame:
    """The lag in buckets at which two envelopes correlate best; the first of equals; none below ``floor``."""
    left = df.where(F.col(a).isNotNull()).select(*keys, F.col(a).alias("_a"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), F.col(bucket).alias("_b")).withColumn("_b", F.col("_b") + F.col("lag"))
    right = df.where(F.col(b).isNotNull()).select(*keys, F.col(bucket).alias("_b"), F.col(b).alias("_v"))
    r = left.join(right, [*keys, "_b"]).groupBy(*keys, "lag").agg(F.count("*").alias("n"), correlation(F.col("_a"), F.col("_v")).alias("r")).where((F.col("n") >= least) & F.col("r").isNotNull())
    best = r.groupBy(*keys).agg(F.max(F.struct("r", (-F.col("lag")).alias("_l"))).alias("_m"))
    return best.select(*keys, (-F.col("_m._l")).alias("lag"), F.col("_m.r").alias("r")).where(F.col("r") >= floor)


def progress(df: DataFrame, keys: list[str], order: str, media: str) -> DataFrame:
    """points, whether media time never falls, its largest step, and its last value."""
    d = df.withColumn("_d", F.col(media) - F.lag(media).over(Window.partitionBy(*keys).orderBy(order)))
    return d.groupBy(*keys).agg(F.count("*").alias("points"), F.coalesce(F.min("_d") >= 0, F.lit(True)).alias("monotonic"), F.max("_d").alias("largest_step"), F.max_by(media, order).alias("last"))


def frames(df: DataFrame, keys: list[str], us: str, missing: str) -> DataFrame:
    """Mean of 1 / gap over positive gaps, largest gap in seconds, share of missing frames."""
    d = df.withColumn("_d", (F.col(us) - F.lag(us).over(Window.partitionBy(*keys).orderBy(us))) / 1e6)
    return d.groupBy(*keys).agg(F.avg(F.when(F.col("_d") > 0, 1 / F.col("_d"))).alias("fps"), F.max("_d").alias("largest_gap_s"), F.avg(F.col(missing).cast("double")).alias("missing_rate"))


def start_spread(df: DataFrame, device: str, order: str, start: str, within: float) -> DataFrame:
    """Each device's start at its first row, its offset to the earliest, and whether all lie ``within``."""
    first = df.groupBy(device).agg(F.min_by(start, order).alias("start"))
    ends = first.agg(F.min("start").alias("_a"), F.max("start").alias("_z"))
    return first.crossJoin(F.broadcast(ends)).select(device, "start", (F.col("start") - F.col("_a")).alias("offset"), (F.col("_z") - F.col("_a")).alias("spread"), (F.col("_z") - F.col("_a") < within).alias("ok"))


def stream_anchors(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(at).alias("first"), F.max(at).alias("last"), (F.max(at) - F.min(at)).alias("duration"), F.count("*").alias("samples"))


def clock_bridge(df: DataFrame, keys: list[str], unified: str, local: str, least: int = 2) -> DataFrame:
    return df.groupBy(*keys).agg(F.when(F.count("*") >= least, F.percentile(F.col(unified) - F.col(local), F.lit(0.5))).alias("offset"))


def tiered_starts(starts: DataFrame, cameras: DataFrame, camera: str, tier: str, start: str, fps: float) -> DataFrame:
    """Frames to skip per camera, from the first tier that has all cameras, else the one with most.

    round((latest start - own start) * fps); a camera that the tier lacks skips 0.
    """
    n = starts.groupBy(tier).agg(F.countDistinct(camera).alias("_n"))
    best = n.agg(F.max_by(tier, F.struct("_n", (-F.col(tier)).alias("_t"))).alias(tier))
    own = starts.join(F.broadcast(best), tier)  # one row
    last = own.agg(F.max(start).alias("_last"))
    skip = own.crossJoin(F.broadcast(last)).select(camera, F.round((F.col("_last") - F.col(start)) * fps).cast("long").alias("skip"))
    return cameras.select(camera).join(skip, camera, "left").withColumn("skip", F.coalesce("skip", F.lit(0).cast("long")))
