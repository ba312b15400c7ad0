"""Splits and folds: rows of every subject by seeded order, whole groups by greedy balance; residuals on several covariates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE_BITS = 8


def seeded_numbers(df: DataFrame, keys: list[str], row: list[str], seed: int, name: str = "_r", total: str = "_n") -> DataFrame:
    """Adds a row's number within its key, from 1, in an order that the seed shuffles, and the key's rows.

    The order is that of a hash of the columns ``row``; a key is cut into 256 ranges of it, so a large one is many tasks' work.
    """
    cut = df.withColumn("_h", F.xxhash64(F.lit(seed), *row)).withColumn("_g", F.shiftright("_h", 64 - _RANGE_BITS))
    sizes = cut.groupBy(*keys, "_g").agg(F.count("*").alias("_s"))
    w = Window.partitionBy(*keys)  # 256 rows a key
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_g").alias("_kg"), (F.sum("_s").over(w.orderBy("_g")) - F.col("_s")).alias("_before"), F.sum("_s").over(w).alias(total))
    same = F.col("_g") == F.col("_kg")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = F.row_number().over(Window.partitionBy(*keys, "_g").orderBy("_h", *row))
    out = cut.withColumn("_l", local).join(sizes, same).withColumn(name, F.col("_before") + F.col("_l"))
    return out.drop("_h", "_g", "_kg", "_l", "_before", *[f"_k{i}" for i in range(len(keys))])


def subject_windows_split(df: DataFrame, subject: str, row: list[str], test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds role so that every subject has rows in each: of its rows in seeded order the first test, the next val, the others train.

    Shares are rounded (half to even), one row at least; where nothing is left to train, one row tests and one validates,
    and a single row tests.
    """
    n, r = F.col("_n"), F.col("_r")
    a, b = F.greatest(F.bround(n * test), F.lit(1)), F.greatest(F.bround(n * val), F.lit(1))
    few = a + b >= n
    a, b = F.when(few, 1).otherwise(a), F.when(few, F.when(n > 1, 1).otherwise(0)).otherwise(b)
    role = F.when(r <= a, "test").when(r <= a + b, "val").otherwise("train")
    return seeded_numbers(df, [subject], row, seed).withColumn("role", role).drop("_r", "_n")


def stratified_split(df: DataFrame, subject: str, row: list[str], test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """The same with shares cut off to whole rows; subjects of fewer than three rows train."""
    n, r = F.col("_n"), F.col("_r")
    a, b = F.greatest(F.floor(n * test), F.lit(1)), F.greatest(F.floor(n * val), F.lit(1))
    few = n - a - b < 1
    b2 = F.greatest(F.lit(1), n - a - 1)
    a, b = F.when(few, n - 1 - b2).otherwise(a), F.when(few, b2).otherwise(b)
    role = F.when(n < 3, "train").when(r <= a, "test").when(r <= a + b, "val").otherwise("train")
    return seeded_numbers(df, [subject], row, seed).withColumn("role", role).drop("_r", "_n")


def fold_phases(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """For groups by falling size, (size, how many): the folds that they go to, each to the one of fewest rows (of equal ones the first).

    (size, first, end, folds): the groups first .. end - 1 of that size take the folds in turn. Folds whose loads differ by
    less than a group take turns as they are until they reach the next one, so there are few phases however many groups.
    """
    load, out = [0] * k, []
    for size, many in sorted(sizes, reverse=True):
        done = 0
        while done < many:
            order = sorted(range(k), key=lambda f: (load[f], f))
            p = next((i for i in range(1, k) if load[order[i]] - load[order[0]] >= size), k)
            rounds = (many - done) // p if p == k else min((many - done) // p, (load[order[p]] - load[order[p - 1]]) // size)
            folds, turns = (order[:p], rounds * p) if rounds else (order[:1], 1)
            out.append((size, done, done + turns, folds))
            for i in range(len(folds)):
                load[folds[i]] += size * (turns // len(folds))
            done += turns
    return out


def balanced_group_folds(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """Adds fold: whole groups, the largest first, each to the fold of fewest rows so far; equal sizes in seeded order.

    Only how many groups have each size goes to the driver: at most the square root of twice the rows.
    """
    own = df.groupBy(group).agg(F.count("*").alias("_size"))
    sizes = [(r["_size"], r["n"]) for r in own.groupBy("_size").agg(F.count("*").alias("n")).collect()]
    phases = df.sparkSession.createDataFrame(fold_phases(sizes, k), "_of long, _first long, _end long, _folds array<int>")
    placed = seeded_numbers(own, ["_size"], [group], seed, "_i", "_many").withColumn("_i", F.col("_i") - 1)
    at = (F.col("_size") == F.col("_of")) & (F.col("_i") >= F.col("_first")) & (F.col("_i") < F.col("_end"))
    turn = ((F.col("_i") - F.col("_first")) % F.size("_folds")).cast("int")
    fold = placed.join(phases, at).select(F.col(group).alias("_group"), F.get("_folds", turn).alias("fold"))
    return df.join(fold, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def refitted(df: DataFrame, fold: str, fit, keys: list[str]) -> DataFrame:
    """What ``fit`` makes of all rows outside each fold, with the fold's number; ``fit`` maps a table and keys to a table by those keys.

    A row stands in each of the other folds once, so folds should be few.
    """
    folds = [r[0] for r in df.select(fold).distinct().collect()]  # a handful
    others = df.withColumn("_out", F.explode(F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col(fold))))
    return fit(others, ["_out", *keys]).withColumnRenamed("_out", fold)


def task_roles(df: DataFrame, task: str, order: list, test, rest: str = "train") -> DataFrame:
    """Rows with role: the test task, the task before it to validate, all earlier ones to train; later ones are left out.

    With nothing before the validating task it trains too, and its rows stand twice. ``rest`` says what rows of the first
    task do instead of training: "train", "baseline-only" (role baseline) or "exclude". The first task can't be the test.
    """
    at = order.index(test)
    if at == 0 or rest not in ("train", "baseline-only", "exclude"):
        raise ValueError("the first task cannot be the test task" if at == 0 else "rest is train, baseline-only or exclude")
    val, train = order[at - 1], order[: at - 1] or [order[at - 1]]
    first = {"train": "train", "baseline-only": "baseline", "exclude": None}[rest]
    roles = [F.when(F.col(task) == test, "test"), F.when(F.col(task) == val, "val")]
    roles += [F.when(F.col(task) == t, F.lit(first if t == order[0] else "train")) for t in train]
    return df.withColumn("role", F.explode(F.array_compact(F.array(*roles))))


def subject_folds(df: DataFrame, subject: str, task: str, c: str, train: list, val, instead, test=None) -> DataFrame:
    """fold (a subject), role, n and mean of ``c``: the others' training tasks train, their task ``val`` validates, the subject's task ``test`` tests (all of its tasks if None).

    Where the others have no rows of ``val``, their task ``instead`` validates. Subjects without test rows are no fold. What the others
    have is the totals less the subject's own, so no row is copied.
    """
    part = lambda ok, name: [F.count_if(ok).alias(f"_n_{name}"), F.count(F.when(ok, F.col(c))).alias(f"_m_{name}"), F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0.0)).alias(f"_s_{name}")]
    is_test = F.lit(True) if test is None else F.coalesce(F.col(task) == test, F.lit(False))
    parts = {"train": F.col(task).isin(train), "val": F.col(task) == val, "instead": F.col(task) == instead, "test": is_test}
    own = df.groupBy(F.col(subject).alias("fold")).agg(*[x for name, ok in parts.items() for x in part(F.coalesce(ok, F.lit(False)), name)])
    sums = own.agg(*[F.sum(f"_{k}_{name}").alias(f"_a{k}_{name}") for name in ("train", "val", "instead") for k in "nms"])  # one row
    both = own.where("_n_test > 0").crossJoin(F.broadcast(sums))
    rest = lambda name: [F.col(f"_a{k}_{name}") - F.col(f"_{k}_{name}") for k in "nms"]
    known = rest("val")[0] > 0
    figures = {"train": rest("train"), "val": [F.when(known, a).otherwise(b) for a, b in zip(rest("val"), rest("instead"))], "test": [F.col(f"_{k}_test") for k in "nms"]}
    rows = F.array(*[F.struct(F.lit(role).alias("role"), n.alias("n"), F.try_divide(s, m).alias("mean")) for role, (n, m, s) in figures.items()])
    return both.select("fold", F.explode(rows).alias("r")).select("fold", "r.*")


def task_summary(df: DataFrame, keys: list[str], participant: str, features: list[str]) -> DataFrame:
    """keys, feature, participants (distinct ones of all rows), rows, n, mean and median of a feature's values."""
    whole = df.groupBy(*keys).agg(F.countDistinct(participant).alias("participants"), F.count("*").alias("rows"))
    long = df.unpivot([*keys], [F.col(f).cast("double").alias(f) for f in features], "feature", "_v")
    each = long.groupBy(*keys, "feature").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.percentile("_v", F.lit(0.5)).alias("median"))
    return each.join(whole, keys).select(*keys, "feature", "participants", "rows", "n", "mean", "median")


# --- several covariates -----------------------------------------------------------------------------


def _moments(names: list[str]) -> list[Column]:
    """Means and population covariances of some columns as arrays, by rows of the upper triangle."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return [F.array(*[F.avg(c) for c in names]).alias("_means"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("_covariances")]


def _square(flat, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    return out + np.triu(out, 1).T


def _complete(df: DataFrame, names: list[str]) -> DataFrame:
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(ok)


def partial_correlations(df: DataFrame, keys: list[str], x: str, y: str, covariates: list[str], least: int = 8) -> DataFrame:
    """keys, n, r: the correlation of what is left of x and y after a linear fit of each on all covariates, over complete rows.

    One aggregation of means and covariances; each key's few numbers are solved by least squares, so covariates may depend on
    one another. Null where x or y has nothing left, and for keys of fewer than ``least`` rows or covariates + 3 no row.
    """
    names = [x, y, *covariates]
    k = len(names)

    @F.pandas_udf(T.DoubleType())
    def solve(flat: pd.Series) -> pd.Series:
        out = []
        for v in flat:
            s = _square(v, k)
            scale = np.sqrt(np.maximum(np.diag(s), 0))
            rest = s[:2, :2] - s[:2, 2:] @ np.linalg.lstsq(s[2:, 2:], s[2:, :2], rcond=1e-12)[0] if k > 2 else s
            ok = (np.diag(rest) > 1e-12 * np.maximum(scale[:2] ** 2, 1e-300)).all()
            out.append(float(np.clip(rest[0, 1] / np.sqrt(rest[0, 0] * rest[1, 1]), -1, 1)) if ok else None)
        return pd.Series(out, dtype=object)

    cast = _complete(df, names).select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    m = cast.groupBy(*keys).agg(F.count("*").alias("n"), *_moments(names)).where(F.col("n") >= max(least, len(covariates) + 3))
    return m.select(*keys, "n", solve("_covariances").alias("r"))


def residuals(df: DataFrame, keys: list[str], y: str, covariates: list[str], name: str = "residual") -> DataFrame:
    """Complete rows of keys of covariates + 3 rows or more, with what a linear fit of y on the covariates leaves."""
    names = [y, *covariates]
    k = len(names)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(flat: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(_square(v, k)[1:, 1:], _square(v, k)[1:, 0], rcond=1e-12)[0].tolist() for v in flat])

    ok = _complete(df, names)
    m = ok.groupBy(*keys).agg(F.count("*").alias("_n"), *_moments(names)).where(F.col("_n") >= len(covariates) + 3)
    fit = m.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_means", solve("_covariances").alias("_slopes"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    left = F.col(y) - F.get("_means", 0)
    for i, c in enumerate(covariates):
        left = left - F.get("_slopes", i) * (F.col(c) - F.get("_means", i + 1))
    return ok.join(fit, same).withColumn(name, left).drop("_means", "_slopes", *[f"_k{i}" for i in range(len(keys))])
