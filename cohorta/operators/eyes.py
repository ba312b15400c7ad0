"""The eye-tracking row of a window with all its flags, and small reports: progress logs, cut weights, left-out scores, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.scalars import flag_text, flags, rating_class, soft_label
from cohorta.operators.features import sample_rate, slope

#: The bounds of the published flags.
BOUNDS = {
    "seconds": 30.0, "hz": (40.0, 60.0), "validity": 0.7, "pupil_coverage": 0.7, "pupil_mm": (1.5, 9.0), "asymmetry_mm": 1.5, "blinks_min": (3.0, 45.0), "out_of_bounds": 0.1, "pupil_speed": 1.0,
    "blink_s": (0.05, 0.4),
}


def eye_row(df: DataFrame, keys: list[str], us: str, x: str, y: str, left: str, right: str, valid: str, order: list[str] | None = None, bounds: dict | None = None) -> DataFrame:
    """One row a key: gaze of the valid samples, both pupils and their mean, blinks, and flags.

    Speeds are between neighbouring samples that are both valid, over positive time; a pupil is the mean of the eyes that
    have one. A blink is a run of invalid samples whose last is 0.05 to 0.4 s after its first. One sample has no duration.
    """
    b = BOUNDS | (bounds or {})
    order = order or [us]
    w = Window.partitionBy(*keys).orderBy(*order)
    ok = F.coalesce(F.col(valid), F.lit(False))
    here = ok & F.col(x).isNotNull() & F.col(y).isNotNull()
    s = df.select(*keys, *dict.fromkeys([us, *order]), ok.alias("_ok"), F.when(ok, F.col(x)).alias("_x"), F.when(ok, F.col(y)).alias("_y"), F.col(left).alias("_l"), F.col(right).alias("_r"), here.alias("_here"))
    s = s.withColumn("_p", F.coalesce((F.col("_l") + F.col("_r")) / 2, "_l", "_r")).withColumn("_i", F.row_number().over(w))
    dt = (F.col(us) - F.lag(us).over(w)) / 1e6
    dt = F.when(dt > 0, dt)
    moved = F.sqrt((F.col("_x") - F.lag("_x").over(w)) ** 2 + (F.col("_y") - F.lag("_y").over(w)) ** 2)
    s = s.withColumn("_v", F.when(F.col("_here") & F.lag("_here").over(w), moved / dt)).withColumn("_pv", F.abs(F.col("_p") - F.lag("_p").over(w)) / dt)
    outside = F.when(F.col("_ok"), (F.col("_here") & ~(F.col("_x").between(0, 1) & F.col("_y").between(0, 1))).cast("double"))
    missing = lambda c: F.avg(F.col(c).isNull().cast("double"))
    a = s.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(F.count("*") > 1, (F.max(us) - F.min(us)) / 1e6).alias("duration_s"), F.avg(F.col("_ok").cast("double")).alias("gaze_valid"), F.avg(outside).alias("gaze_out"),
        F.avg("_x").alias("gaze_x_mean"), F.avg("_y").alias("gaze_y_mean"), F.stddev_pop("_x").alias("gaze_x_sd"), F.stddev_pop("_y").alias("gaze_y_sd"), F.avg("_v").alias("speed_mean"), F.percentile("_v", F.lit(0.95)).alias("speed_p95"),
        F.avg("_p").alias("pupil_mean"), F.stddev_pop("_p").alias("pupil_sd"), missing("_p").alias("pupil_missing"), F.when(F.count("_p") > 1, F.max("_p") - F.min("_p")).alias("pupil_range"), F.avg("_pv").alias("pupil_speed"),
        F.avg("_l").alias("left_mean"), F.avg("_r").alias("right_mean"), F.stddev_pop("_l").alias("left_sd"), F.stddev_pop("_r").alias("right_sd"), missing("_l").alias("left_missing"), missing("_r").alias("right_missing"),
        F.avg(F.abs(F.col("_l") - F.col("_r"))).alias("eyes_apart"), F.count_if(F.col("_ok")).alias("_valid"),
    )
    middle = a.select(*keys, F.col("gaze_x_mean").alias("_cx"), F.col("gaze_y_mean").alias("_cy"))
    far = s.where("_ok").join(middle, keys).groupBy(*keys).agg(F.avg(F.sqrt((F.col("_x") - F.col("_cx")) ** 2 + (F.col("_y") - F.col("_cy")) ** 2)).alias("_far"))
    runs = s.where("not _ok").withColumn("_run", F.col("_i") - F.row_number().over(w)).groupBy(*keys, "_run").agg(((F.max(us) - F.min(us)) / 1e6).alias("_s"))
    blinks = runs.where(F.col("_s").between(*b["blink_s"])).groupBy(*keys).agg(F.count("*").alias("blinks"), F.avg("_s").alias("blink_s"))
    trend = slope(s.withColumn("_t", F.col(us) / 1e6), keys, "_t", "_p").withColumnRenamed("slope", "pupil_slope")
    out = a.join(far, keys, "left").join(blinks, keys, "left").join(trend, keys, "left").join(sample_rate(df.select(*keys, us), keys, us), keys, "left")
    out = out.withColumn("dispersion", F.when(F.col("_valid") > 1, F.col("_far"))).withColumn("blinks", F.coalesce("blinks", F.lit(0))).withColumn("blinks_min", F.when(F.col("duration_s") > 0, F.col("blinks") / (F.col("duration_s") / 60)))
    c = lambda name: F.col(name)
    true = lambda e: F.coalesce(e, F.lit(False))
    low = 1 - b["pupil_coverage"]
    found = flags(
        short_duration=true(c("duration_s") < b["seconds"]), sample_rate_unavailable=c("rate_hz").isNull(), sample_rate_unusual=true(~c("rate_hz").between(*b["hz"])), gaze_low_validity=c("gaze_valid") < b["validity"],
        pupil_low_coverage=c("pupil_missing") > low, pupil_left_low_coverage=c("left_missing") > low, pupil_right_low_coverage=c("right_missing") > low, pupil_implausible=true(~c("pupil_mean").between(*b["pupil_mm"])),
        pupil_asymmetry_large=true(c("eyes_apart") > b["asymmetry_mm"]), blink_rate_unusual=true(~c("blinks_min").between(*b["blinks_min"])), gaze_out_of_bounds=true(c("gaze_out") > b["out_of_bounds"]),
        pupil_velocity_spike=true(c("pupil_speed") > b["pupil_speed"]),
    )
    return out.withColumn("qc", flag_text(found)).drop("_far", "_valid")


def progress_counts(df: DataFrame, keys: list[str], order: list[str], media: str, dropped: str, doubled: str) -> DataFrame:
    """points, monotonic (media time never falls), largest_gap (0 for one point), and the last row's dropped and doubled frames (0 if null)."""
    d = df.withColumn("_d", F.col(media) - F.lag(media).over(Window.partitionBy(*keys).orderBy(*order)))
    last = F.max_by(F.struct(F.coalesce(F.col(dropped), F.lit(0)).alias("a"), F.coalesce(F.col(doubled), F.lit(0)).alias("b")), F.struct(*order))
    a = d.groupBy(*keys).agg(F.count("*").alias("points"), F.coalesce(F.min("_d") >= 0, F.lit(True)).alias("monotonic"), F.coalesce(F.max("_d"), F.lit(0)).alias("largest_gap"), last.alias("_l"))
    return a.select(*keys, "points", "monotonic", "largest_gap", F.col("_l.a").alias("dropped"), F.col("_l.b").alias("doubled"))


def cut_weights(df: DataFrame, keys: list[str], label: str, classes: int = 9, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """keys, cut (1 .. classes - 1), positive and weight: labels at or below each cut over those above it (one at least), clipped."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"), F.array(*[F.count_if(F.col(label) > k) for k in range(1, classes)]).alias("_above"))
    each = counts.select(*keys, "_n", F.posexplode("_above").alias("_k", "positive"))
    weight = F.least(F.greatest((F.col("_n") - F.col("positive")) / F.greatest("positive", F.lit(1)), F.lit(low)), F.lit(high))
    return each.select(*keys, (F.col("_k") + 1).alias("cut"), "positive", weight.alias("weight"))


def left_out_scores(posterior: DataFrame, t1: float, t2: float) -> DataFrame:
    """Adds to each report (y) and its posterior from the others (mu, sigma): soft, hard (0 .. 2), predicted (likeliest, first of equals), top, brier and correct."""
    p = posterior.withColumn("soft", soft_label(F.col("mu"), F.col("sigma"), t1, t2)).withColumn("hard", rating_class(F.col("y"), t1, t2).cast("int"))
    p = p.withColumn("top", F.array_max("soft")).withColumn("predicted", (F.array_position("soft", F.col("top")) - 1).cast("int"))
    miss = F.aggregate(F.transform("soft", lambda m, k: (m - (k == F.col("hard")).cast("double")) ** 2), F.lit(0.0), lambda a, e: a + e)
    return p.withColumn("brier", miss / 3).withColumn("correct", F.col("hard") == F.col("predicted"))


def speaker_turns(segments: DataFrame, keys: list[str], order: list[str], speaker: str, confidence: str, uncertain: str = "uncertain") -> DataFrame:
    """Per key and speaker: segments, turns (segments after another speaker's; the first never counts), and the uncertain share of its segments."""
    before = F.lag(speaker).over(Window.partitionBy(*keys).orderBy(*order))
    s = segments.withColumn("_turn", F.coalesce((before != F.col(speaker)).cast("int"), F.lit(0)))
    return s.groupBy(*keys, speaker).agg(F.count("*").alias("segments"), F.sum("_turn").alias("turns"), F.round(F.avg(F.coalesce(F.col(confidence) == uncertain, F.lit(False)).cast("double")), 4).alias("uncertain_share"))
