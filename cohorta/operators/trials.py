"""Trials of a stimulus data set: their windows and summaries, window tables, track smoothing, made-up variants."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.operators.joins import range_join
from cohorta.operators.signals import low_pass


def stimulus_windows(labels: DataFrame, events: DataFrame, keys: list[str], order: str, onset: str, duration: str, flag: str, shown: str = "video", least=1, default=5) -> DataFrame:
    """Label rows with from and until: when their stimulus was shown.

    ``keys`` name the recording and the stimulus. Of the events of a key those flagged ``shown`` (any
    case) count, or all if none is; onset and duration are the first of them, by ``order``, that
    are not null. A missing duration is ``default``, a shorter one than ``least`` is ``least``. Label
    rows without an onset go.
    """
    known = F.coalesce(F.lower(flag) == shown, F.lit(False))
    e = events.withColumn("_k", known).groupBy(*keys).agg(*[
        F.min_by(F.when(mine, F.col(c)), F.when(mine & F.col(c).isNotNull(), F.col(order))).alias(f"_{c}_{k}")
        for c in (onset, duration) for k, mine in (("s", F.col("_k")), ("a", F.lit(True)))
    ], F.max("_k").alias("_any"))
    pick = lambda c: F.when(F.col("_any"), F.col(f"_{c}_s")).otherwise(F.col(f"_{c}_a"))
    start = pick(onset)
    w = labels.join(e, keys).where(start.isNotNull())
    return w.select(*labels.columns, start.alias("from"), (start + F.greatest(F.coalesce(pick(duration), F.lit(default)), F.lit(least))).alias("until"))


def trial_samples(samples: DataFrame, windows: DataFrame, keys: list[str], at: str, bucket: int, extra=0) -> DataFrame:
    """Samples of every trial from its start to its end, both included, and ``extra`` longer."""
    longer = windows.withColumn("_until", F.col("until") + F.lit(extra))
    return range_join(samples, longer, keys, at, "from", "_until", bucket, closed_end=True).drop("_until")


def carried(df: DataFrame, keys: list[str], order: str, defaults: dict) -> DataFrame:
    """Missing values take the last one before them in their key, or else the column's default."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(w), F.lit(d)) for c, d in defaults.items()})


def _spread(columns: list[str]) -> list:
    """Mean and population deviation of each column; 0 without values."""
    return [F.coalesce(f(c), F.lit(0.0)).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]


def gaze_summary(df: DataFrame, keys: list[str], order: str, x: str, y: str, valid: str) -> DataFrame:
    """Place, validity and mean step of a trial's gaze; missing places are carried on, at first the middle, 0.5."""
    w = Window.partitionBy(*keys).orderBy(order)
    g = carried(df, keys, order, {x: 0.5, y: 0.5})
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in (x, y)), F.lit(0.0)))
    return g.withColumn("_step", step).groupBy(*keys).agg(*_spread([x, y]), F.avg(F.coalesce(F.col(valid).cast("double"), F.lit(0.0))).alias("validity_rate"), F.coalesce(F.avg("_step"), F.lit(0.0)).alias("saccade_proxy"))


def pupil_summary(df: DataFrame, keys: list[str], left: str, right: str, valid: str) -> DataFrame:
    """Size of each pupil and of both, and the share of blinks; a size of 0 is missing."""
    seen = lambda c: F.when(F.col(c) != 0, F.col(c))
    both = (F.coalesce(F.col(left), F.col(right)) + F.coalesce(F.col(right), F.col(left))) / 2
    p = df.withColumns({left: seen(left), right: seen(right)}).withColumn("pupil", both)
    open_ = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(valid).cast("double"), F.lit(0.0))))
    return p.groupBy(*keys).agg(*_spread([left, right, "pupil"]), (1 - F.avg(open_)).alias("blink_rate"))


def conductance_summary(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """The tonic part, a centred moving sum over ``width`` rows by ``width``, and the phasic rest.

    Missing values are carried on, at first 0. Past the ends there is nothing to add, so the tonic
    part falls there. Trials of fewer than four rows have 0 throughout.
    """
    w = Window.partitionBy(*keys)
    after = (width - 1) // 2
    e = carried(df, keys, order, {value: 0.0}).withColumn("_n", F.count("*").over(w))
    e = e.withColumn("tonic", F.sum(value).over(w.orderBy(order).rowsBetween(after + 1 - width, after)) / width).withColumn("phasic", F.col(value) - F.col("tonic"))
    long_ = lambda c: F.when(F.col("_n") >= 4, F.col(c))
    return e.select(*keys, long_("tonic").alias("tonic"), long_("phasic").alias("phasic")).groupBy(*keys).agg(*_spread(["tonic", "phasic"]))


def motion_summary(df: DataFrame, keys: list[str], order: str, axes: list[str], name: str) -> DataFrame:
    """Mean and deviation of each axis and of their length; missing values are carried on, at first 0."""
    m = carried(df, keys, order, dict.fromkeys(axes, 0.0))
    m = m.withColumn(name, F.sqrt(sum((F.col(c) ** 2 for c in axes), F.lit(0.0))))
    return m.groupBy(*keys).agg(*_spread([*axes, name]))


def task_bounds(rows: DataFrame, keys: list[str], order: str, task: str, start: str, end: str, tasks: list[str]) -> DataFrame:
    """keys, task and its start and end, of the named tasks only; of a task given twice the later row counts."""
    named = rows.withColumn(task, F.trim(task)).where(F.col(task).isin(tasks))
    return named.groupBy(*keys, task).agg(*[F.max_by(F.col(c).cast("double"), order).alias(c) for c in (start, end)])


def first_offset(rows: DataFrame, keys: list[str], order: str, offset: str) -> DataFrame:
    """keys and the first value of ``offset`` that is a number; null where there is none."""
    number = F.expr(f"try_cast(`{offset}` AS double)")
    return rows.withColumn("_v", number).groupBy(*keys).agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias(offset))


def smoothed_tracks(df: DataFrame, keys: list[str], frame: str, coords: list[str], rate: float, cutoff: float = 6.0, least: int = 10) -> DataFrame:
    """keys, frame and coords, low-passed forward and back in every run of frames that follow on each other and have all coords.

    Runs shorter than ``least`` and frames without coordinates stay as they are. A run is one task's work.
    """
    ok = F.lit(True)
    for c in coords:
        ok &= F.col(c).isNotNull() & ~F.isnan(c)
    run = F.col(frame) - F.row_number().over(Window.partitionBy(*keys, "_ok").orderBy(frame))
    rows = df.select(*keys, frame, *[F.col(c).cast("double").alias(c) for c in coords]).withColumn("_ok", ok).withColumn("_run", run)
    size = F.count("*").over(Window.partitionBy(*keys, "_ok", "_run"))
    rows = rows.withColumn("_long", F.col("_ok") & (size >= least))
    cut = min(cutoff, 0.45 * rate)

    def smooth(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(frame)
        for c in coords:
            part[c] = low_pass(part[c].to_numpy(), rate, cut)
        return part

    done = [*keys, frame, *coords]
    runs = rows.where("_long").select(*done, "_run")
    return runs.groupBy(*keys, "_run").applyInPandas(smooth, runs.schema).select(*done).union(rows.where(~F.col("_long")).select(*done))


def augmented(df: DataFrame, key: str, sequence: str, copies: int, noise: float = 0.05, scale: tuple[float, float] = (0.85, 1.15), shift: int = 20, seed: int = 0) -> DataFrame:
    """Every row ``copies`` times, with copy from 1 and a varied sequence of the same length.

    Noise is normal, in shares of the sequence's own deviation; then the whole is scaled by one factor
    and turned round by up to ``shift`` steps. The draws depend on key, copy and seed only, so a
    lost task gives the same rows again. Null and empty sequences stay.
    """

    @F.pandas_udf("array<double>")
    def vary(x: pd.Series, k: pd.Series, copy: pd.Series) -> pd.Series:
        out = []
        for v, name, c in zip(x, k, copy):
            if v is None or not len(v):
                out.append(v)
                continue
            rng, v = np.random.default_rng([seed, zlib.crc32(str(name).encode()), int(c)]), np.asarray(v, float)
            y = (v + rng.standard_normal(len(v)) * noise * max(v.std(), 1e-6)) * rng.uniform(*scale)
            out.append(np.roll(y, rng.integers(-shift, shift + 1)))
        return pd.Series(out)

    many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return many.withColumn(sequence, vary(F.col(sequence).cast("array<double>"), F.col(key).cast("string"), "copy"))


def variant_scores(df: DataFrame, variants: dict[str, Callable[[DataFrame], DataFrame]], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``score`` for every variant of ``df``, with the variant's name; one plan for all of them."""
    parts = [score(make(df)).select(F.lit(name).alias("variant"), "*") for name, make in variants.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
