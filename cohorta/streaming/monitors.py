"""Structured Streaming variants of three batch operators; each gives what its batch twin gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_features(samples: DataFrame, ts: str, key: str, value: str, width: str, step: str, late: str) -> DataFrame:
    """Count, mean and extremes by key and sliding window of event time; rows later than ``late`` are lost."""
    w = F.window(ts, width, step)
    return samples.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(key, F.col("window.start").alias("start"), "n", "mean", "min", "max")


def batch_sliding_features(samples: DataFrame, ts: str, key: str, value: str, width: str, step: str) -> DataFrame:
    """The same windows over a table."""
    return samples.groupBy(F.window(ts, width, step), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(key, F.col("window.start").alias("start"), "n", "mean", "min", "max")


def reset_monitor(progress: DataFrame, device: str, order: str, media: str, drop: float) -> DataFrame:
    """A row whenever a device's media time falls by more than ``drop``; keeps one number a device.

    Rows must reach the stream in order by device; within a batch they are sorted.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(order)
        last = state.get[0] if state.exists else None
        out = []
        for o, m in zip(rows[order], rows[media]):
            if last is not None and last - m > drop:
                out.append((key[0], int(o), float(last), float(m)))
            last = m
        state.update((float(last),))
        yield pd.DataFrame(out, columns=["device", "at", "before", "after"])

    kind = dict(progress.dtypes)[device]
    return progress.groupBy(device).applyInPandasWithState(watch, f"device {kind}, at long, before double, after double", "last double", "append", GroupStateTimeout.NoTimeout)


def enriched(events: DataFrame, windows: DataFrame, session: str, at: str, start: str, end: str) -> DataFrame:
    """Stream-static join: each event with the task windows of its session that hold it."""
    return events.join(windows, session).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).withColumn("onset", F.col(at) - F.col(start))
