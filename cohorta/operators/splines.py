"""Cubic splines: gaps of a track, and sequences whose time axis is bent or pressed together."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points of a block whose gaps one task fills, and points on both sides that still tell on it: a point's weight falls to
#: a quarter or so with each point between, so beyond them it is below what a double can show.
BLOCK, MARGIN = 512, 48


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through rising points whose first two and last two pieces are one cubic each; below 4 points straight lines."""
    n = len(x)
    if n < 4:
        return np.interp(at, x, y)
    h = np.diff(x).astype(float)
    d = np.diff(y) / h
    low, mid, up, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(d)
    # The end curvatures in terms of their neighbours' put into the first and last row.
    mid[0] += h[0] * (1 + h[0] / h[1])
    up[0] -= h[0] ** 2 / h[1]
    mid[-1] += h[-1] * (1 + h[-1] / h[-2])
    low[-1] -= h[-1] ** 2 / h[-2]
    for i in range(1, n - 2):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        right[i] -= w * right[i - 1]
    m = np.empty(n)
    m[n - 2] = right[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (right[i] - up[i] * m[i + 2]) / mid[i]
    m[0] = m[1] + (m[1] - m[2]) * h[0] / h[1]
    m[-1] = m[-2] + (m[-2] - m[-3]) * h[-1] / h[-2]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = x[k + 1] - at, at - x[k]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b


def filled_cubic(df: DataFrame, keys: list[str], order: str, c: str, most: int = 10) -> DataFrame:
    """Adds filled: gaps of up to ``most`` rows between values take the spline through all of the key's values, by row number.

    Keys of fewer than 4 values take straight lines; gaps at the ends and longer ones stay. A key's values are dealt to blocks,
    each with what tells on it from both sides.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    value = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = df.withColumn("_y", value).withColumn("_x", F.row_number().over(w)).withColumn("_i", F.count("_y").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    there = F.when(F.col("_y").isNotNull(), F.col("_x"))
    before, after = F.last(there, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(there, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_gap", F.col("_y").isNull() & F.coalesce(after - before - 1 <= most, F.lit(False))).withColumn("_b", F.floor((F.col("_i") - 1) / BLOCK))
    near = F.sequence(F.floor((F.col("_i") - 1 - MARGIN) / BLOCK), F.floor((F.col("_i") - 1 + MARGIN) / BLOCK))
    need = rows.where("_gap").select(*keys, "_b", "_x", F.lit(None).cast("double").alias("_y"))
    points = rows.where("_y is not null").select(*keys, F.explode(near).alias("_b"), "_x", "_y")
    types = dict(need.dtypes)

    def fill(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_x")
        known = part["_y"].notna()
        at = part.loc[~known, "_x"].to_numpy(float)
        y = spline(part.loc[known, "_x"].to_numpy(float), part.loc[known, "_y"].to_numpy(float), at) if len(at) else at
        out = pd.DataFrame({"_x": part.loc[~known, "_x"], "_f": y})
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, "_x", "_f"]]

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", _x {types['_x']}, _f double"
    found = points.unionByName(need).groupBy(*keys, "_b").applyInPandas(fill, schema)
    found = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_x").alias("_at"), "_f")
    same = F.col("_x") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(found, same, "left").withColumn("filled", F.coalesce("_y", F.when(F.col("_gap"), F.col("_f"))))
    return out.drop("_y", "_x", "_i", "_b", "_gap", "_at", "_f", *[f"_k{i}" for i in range(len(keys))])


def bent(x: np.ndarray, rng: np.random.Generator, knots: int, sigma: float) -> np.ndarray:
    """A sequence read along a bent time axis: a spline through evenly spaced knots moved by chance, its ends fixed."""
    n = len(x)
    even = np.linspace(0, n - 1, knots + 2)
    moved = np.sort(even + rng.normal(0, sigma * n / knots, knots + 2))
    moved[0], moved[-1] = 0, n - 1
    return np.interp(np.clip(spline(even, moved, np.arange(n, dtype=float)), 0, n - 1), np.arange(n), x)


def pressed(x: np.ndarray, rng: np.random.Generator, share: float) -> np.ndarray:
    """A stretch of a sequence, ``share`` of it and begun by chance, pressed to half its length; zeros make up the end."""
    n = len(x)
    half = max(int(n * share / 2), 4)
    start = int(rng.integers(0, max(n - 2 * half, 1)))
    if n <= 2 * half:
        return x.copy()
    short = np.interp(np.linspace(0, 2 * half - 1, half), np.arange(2 * half), x[start : start + 2 * half])
    return np.concatenate((x[:start], short, x[start + 2 * half :], np.zeros(half)))


def warped(df: DataFrame, key: str, sequence: str, copies: int, how: str, *, noise: float = 0.05, scale: tuple[float, float] = (0.85, 1.15), knots: int = 4, sigma: float = 0.2, share: float = 0.5, seed: int = 0) -> DataFrame:
    """Every row ``copies`` times, with copy from 1 and a varied sequence of the same length.

    how: "time" (noise in shares of the sequence's deviation, one factor, then a bent time axis) or "window" (a stretch
    pressed together). The draws depend on key, copy and seed only. Null and empty sequences stay; missing values count as 0.
    """
    if how not in ("time", "window"):
        raise ValueError("how is time or window")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vary(x: pd.Series, k: pd.Series, copy: pd.Series) -> pd.Series:
        out = []
        for v, name, c in zip(x, k, copy):
            if v is None or not len(v):
                out.append(v)
                continue
            rng, v = np.random.default_rng([seed, zlib.crc32(str(name).encode()), int(c)]), np.nan_to_num(np.asarray(v, float))
            if how == "window":
                out.append(pressed(v, rng, share))
            else:
                out.append(bent((v + rng.standard_normal(len(v)) * noise * max(v.std(), 1e-6)) * rng.uniform(*scale), rng, knots, sigma))
        return pd.Series(out)

    many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return many.withColumn(sequence, vary(F.col(sequence).cast("array<double>"), F.col(key).cast("string"), "copy"))
