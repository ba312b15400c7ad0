"""Interval, nearest and band joins, and lookups between tables of one session."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(samples: DataFrame, windows: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: int, closed_end: bool = False) -> DataFrame:
    """Samples with every window of their key that holds them: start <= at < end (or <= end).

    Both sides meet on the key and a time bucket, so neither is sent whole and a long session
    is spread over its buckets; a window stands in every bucket that it touches. ``bucket``
    is in units of ``at`` and should be about a window's length.
    """
    spread = windows.where(F.col(end) >= F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    inside = F.col(at) <= F.col(end) if closed_end else F.col(at) < F.col(end)
    return samples.withColumn("_b", F.floor(F.col(at) / bucket)).join(spread, [*keys, "_b"]).where((F.col(at) >= F.col(start)) & inside).drop("_b")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of intervals of one key that overlap by more than nothing: a0 < b1 and a1 > b0."""
    cut = lambda df, s, e: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.greatest(F.col(s), F.col(e)) / bucket))))
    both = cut(left, *a).join(cut(right, *b), [*keys, "_b"]).where((F.col(a[0]) < F.col(b[1])) & (F.col(a[1]) > F.col(b[0])))
    # A pair that shares several buckets counts in the first of them only.
    return both.where(F.col("_b") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / bucket)).drop("_b")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, most: float | None = None) -> DataFrame:
    """Each left row with the right row of its key that is nearest in ``at``; a tie takes the earlier.

    Adds near_at and near_value; beyond ``most`` both are null. One sort of both sides
    together, no pairs. Right rows with a null value compete too, and then give null.
    """
    one = left.select("*", F.lit(None).cast(dict(right.dtypes)[at]).alias("_at"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"))
    names = set(right.columns)
    fill = [F.col(c) if c in keys or c == at else F.lit(None).cast(t).alias(c) for c, t in left.dtypes]
    if not set([*keys, at, value]) <= names:
        raise ValueError("the right side needs the keys, the time and the value")
    two = right.select(*fill, F.col(at).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys)
    there = F.when(F.col("_side") == 0, F.struct("_at", "_v"))
    before = F.last(there, True).over(w.orderBy(F.col(at), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(there, True).over(w.orderBy(F.col(at).desc(), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0))
    both = one.unionByName(two).withColumn("_p", before).withColumn("_n", after).where("_side = 1")
    gap_b, gap_a = F.col(at) - F.col("_p._at"), F.col("_n._at") - F.col(at)
    pick = F.when(F.col("_n").isNull() | (gap_b <= gap_a), F.col("_p")).otherwise(F.col("_n"))
    out = both.withColumn("_m", pick)
    ok = F.lit(True) if most is None else F.abs(F.col("_m._at") - F.col(at)) <= most
    return out.withColumn("near_at", F.when(ok, F.col("_m._at"))).withColumn("near_value", F.when(ok, F.col("_m._v"))).drop("_at", "_v", "_side", "_p", "_n", "_m")


def grid(bounds: DataFrame, start: str, end: str, step: int, name: str) -> DataFrame:
    """A row for every step from start to end, both included."""
    return bounds.withColumn(name, F.explode(F.sequence(F.lit(0), F.floor((F.col(end) - F.col(start)) / step)))).withColumn(name, F.col(start) + F.col(name) * step)


def resampled_grid(frames: DataFrame, keys: list[str], us: str, value: str, step_us: int, tolerance_us: int) -> DataFrame:
    """Fixed-rate rows from each key's first to last frame: the nearest frame, or is_missing."""
    points = grid(frames.groupBy(*keys).agg(F.min(us).alias("_a"), F.max(us).alias("_z")), "_a", "_z", step_us, us).drop("_a", "_z")
    out = nearest(points, frames.select(*keys, us, value), keys, us, value, tolerance_us)
    return out.withColumn("is_missing", F.col("near_at").isNull().cast("int"))


def backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row at or before it, else the first right row."""
    fill = [F.col(c) if c in keys or c == at else F.lit(None).cast(t).alias(c) for c, t in left.dtypes]
    row = F.struct(F.col(at).alias("_at"), *values)
    one = left.withColumn("_r", F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType)).withColumn("_side", F.lit(1))
    two = right.select(*fill, row.alias("_r"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(at, "_side")
    last = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_r", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = one.unionByName(two).withColumn("_m", F.coalesce(last, first)).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_m.{v}").alias(v) for v in values])


def piecewise_clock(samples: DataFrame, segments: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds mapped = scale * at + offset of the last segment that starts at or before the sample."""
    return backward(samples, segments, keys, at, ["scale", "offset"]).withColumn("mapped", F.col("scale") * F.col(at) + F.col("offset")).drop("scale", "offset")


def speech_features(windows: DataFrame, utterances: DataFrame, keys: list[str], bucket: int, clip_start: bool = False) -> DataFrame:
    """Per window: n_utterances, speech, words, mean and longest duration, words a second, share.

    windows: keys, w_start, w_end; utterances: keys, onset, duration, words. An utterance
    counts by min(duration, w_end - onset), not cut at the window's start unless asked. A
    window without utterances has zeros; one whose key has none at all has nulls.
    """
    u = utterances.withColumn("u_end", F.col("onset") + F.col("duration"))
    from_ = F.greatest("onset", "w_start") if clip_start else F.col("onset")
    length = F.least(F.col("u_end") - from_ if clip_start else F.col("duration"), F.greatest(F.col("w_end") - from_, F.lit(0)))
    hit = overlap_join(u, windows, keys, ("onset", "u_end"), ("w_start", "w_end"), bucket).withColumn("d", length)
    agg = hit.groupBy(*keys, "w_start", "w_end").agg(F.count("*").alias("n_utterances"), F.sum("d").alias("speech"), F.sum("words").alias("words"), F.avg("d").alias("mean_duration"), F.max("d").alias("longest"))
    known = utterances.select(*keys).distinct().withColumn("_known", F.lit(True))
    out = windows.join(agg, [*keys, "w_start", "w_end"], "left").join(known, keys, "left")
    for c in ("n_utterances", "speech", "words", "mean_duration", "longest"):
        out = out.withColumn(c, F.when(F.col("_known"), F.coalesce(F.col(c), F.lit(0))))
    return out.withColumn("words_per_unit", F.when(F.col("speech") > 0, F.col("words") / F.col("speech")).otherwise(F.col("speech") * 0.0)).withColumn("share", F.col("speech") / (F.col("w_end") - F.col("w_start"))).drop("_known")


def expected_grid(dims: list[DataFrame], found: DataFrame, keys: list[str], missing: dict) -> DataFrame:
    """Every combination of small dimension tables, with what was found or the defaults.

    The dimensions are lists of sessions, tasks and seats: their product is the report.
    """
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(d)
    out = out.join(found, keys, "left")
    for c, v in missing.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, width: int, other: str) -> DataFrame:
    """Pairs of rows of one key and different ``other`` at most ``width`` apart in ``at``.

    Right columns get the prefix ``r_``; each right row stands in three buckets, left ones in one.
    """
    r = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])
    r = r.withColumn("_c", F.floor(F.col(f"r_{at}") / width)).withColumn("_b", F.explode(F.sequence(F.col("_c") - 1, F.col("_c") + 1))).drop("_c")
    hit = left.withColumn("_b", F.floor(F.col(at) / width)).join(r, [*keys, "_b"]).drop("_b")
    return hit.where((F.col(other) != F.col(f"r_{other}")) & (F.abs(F.col(at) - F.col(f"r_{at}")) <= width))


def first_report_near(reports: DataFrame, keys: list[str], seat: str, at: str, width: int) -> DataFrame:
    """For each report and other seat: that seat's first report at most ``width`` away."""
    pairs = band_join(reports, reports, keys, at, width, seat)
    w = Window.partitionBy(*keys, seat, at, f"r_{seat}").orderBy(f"r_{at}")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def near_or_first(left: DataFrame, right: DataFrame, keys: list[str], seat: str, at: str, width: int, most: int = 3) -> DataFrame:
    """Other seats' rows within ``width``; a row without any gets each other seat's first ``most``."""
    near = band_join(left, right, keys, at, width, seat)
    w = Window.partitionBy(*keys, seat).orderBy(at)
    first = right.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    first = first.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in first.columns])
    none = left.join(near.select(*keys, seat, at).distinct(), [*keys, seat, at], "left_anti")
    return near.unionByName(none.join(first, keys).where(F.col(seat) != F.col(f"r_{seat}")))


def dyads(df: DataFrame, keys: list[str], member: str, values: list[str]) -> DataFrame:
    """Unordered pairs of members of one key, with both members' values."""
    a = df.select(*keys, F.col(member).alias("a"), *[F.col(v).alias(f"{v}_a") for v in values])
    b = df.select(*keys, F.col(member).alias("b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return a.join(b, keys).where("a < b")


def partner_windows(windows: DataFrame, keys: list[str], seat: str, at: str, most_gap: int) -> DataFrame:
    """For each window and other seat, its window of the same ordinal, else one before, else after.

    Only windows at most ``most_gap`` apart match; the first of the three that does counts.
    """
    w = Window.partitionBy(*keys, seat).orderBy(at)
    own = windows.select(*keys, seat, at).withColumn("ordinal", F.row_number().over(w))
    other = own.select(*keys, F.col(seat).alias("partner"), F.col(at).alias("partner_at"), F.col("ordinal").alias("partner_ordinal"), F.explode(F.array(*[F.struct(F.lit(p).alias("preference"), F.lit(d).alias("shift")) for p, d in ((0, 0), (1, 1), (2, -1))])).alias("s"))
    other = other.withColumn("ordinal", F.col("partner_ordinal") + F.col("s.shift"))
    hit = own.join(other, [*keys, "ordinal"]).where((F.col(seat) != F.col("partner")) & (F.abs(F.col(at) - F.col("partner_at")) <= most_gap))
    best = F.row_number().over(Window.partitionBy(*keys, seat, at, "partner").orderBy("s.preference"))
    return hit.withColumn("_n", best).where("_n = 1").drop("_n", "s")


def overlap_length(a0, a1, b0, b1) -> Column:
    return F.greatest(F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0)), F.lit(0))


def whole_hour_repair(recordings: DataFrame, start: str, length: str, session_start: str, session_end: str, most: int = 14) -> DataFrame:
    """Adds shift_h, the whole hours that make a recording overlap its session most (tie: fewest).

    Times in seconds; no overlap at any shift leaves 0.
    """
    def overlap(h):
        a = F.col(start) + h * 3600
        return F.greatest(F.least(a + F.col(length), F.col(session_end)) - F.greatest(a, F.col(session_start)), F.lit(0))

    tried = F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda h: F.struct(overlap(h).alias("o"), (-F.abs(h)).alias("near"), h.alias("h")))
    best = F.array_max(tried)
    return recordings.withColumn("shift_h", F.when(best["o"] > 0, best["h"]).otherwise(0))


def _shared_pieces(l: DataFrame, r: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (_a, _b) of names among which are all that reach the cutoff.

    A right name of n letters has at most k = n (1 - cutoff) / cutoff edits to such a left name,
    so one of its k + 1 pieces is left whole, moved by k places at most.
    """
    n, edits = F.length("_b"), F.floor(F.length("_b") * ((1 - cutoff) / cutoff) + 1e-9).cast("int")
    start = lambda i: F.floor(i * n / (edits + 1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct(start(i).alias("y"), F.substr("_b", start(i) + 1, start(i + 1) - start(i)).alias("piece")))
    pieces = r.select("_b").distinct().select("_b", edits.alias("k"), F.inline(cut))
    m, longest = F.length("_a"), math.ceil(cutoff / (1 - cutoff) - 1e-9)
    sizes = F.when(m > 0, F.sequence(F.lit(1), F.least(m, F.lit(longest)))).otherwise(F.array(F.lit(0)))
    within = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(0), m - s), lambda x: F.struct(x.alias("x"), F.substr("_a", x + 1, s).alias("piece")))))
    parts = l.select("_a").distinct().select("_a", F.inline(within))
    fits = F.least(m, n) >= cutoff * F.greatest(m, n) - 1e-9
    return parts.join(pieces, "piece").where(fits & (F.abs(F.col("x") - F.col("y")) <= F.col("k"))).select("_a", "_b").distinct()


def fuzzy_match(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float = 0.8, same_first: bool = False) -> DataFrame:
    """The closest right name of each left name by edit distance; same_first: of those with its first letter.

    similarity = 1 - distance / longer length, at least ``cutoff`` (below 1); ties go to the smaller name.
    """
    name = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    l, r = left.withColumn("_a", name(F.col(a))), right.withColumn("_b", name(F.col(b)))  # noqa: E741
    if same_first:
        met = l.join(r, F.substring("_a", 1, 1) == F.substring("_b", 1, 1))
    else:
        met = l.join(_shared_pieces(l, r, cutoff), "_a").join(r, "_b")
    hit = met.withColumn("similarity", 1 - F.levenshtein("_a", "_b") / F.greatest(F.length("_a"), F.length("_b"), F.lit(1)))
    best = F.row_number().over(Window.partitionBy(a).orderBy(F.col("similarity").desc(), b))
    return hit.where(F.col("similarity") >= cutoff).withColumn("_n", best).where("_n = 1").drop("_n", "_a", "_b")
