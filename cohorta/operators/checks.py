"""Checks of labels and matches: ridge with each row left out, task splits, keys expected, quality of matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.operators import ranks


def _places(df: DataFrame, c: str, shares: tuple[float, ...]) -> DataFrame:
    """One row: for each share q the three values from place floor(q (n - 2)) on, in rising order, as ``q{k}_{i}``."""
    r = ranks.running(ranks.value_counts(df, [], c), [], c, "_m", ranks.split_points(df, c))
    at = lambda q, i: F.floor(F.lit(q) * (F.col("_total") - 2)) + i
    held = lambda q, i: (F.col("_before") <= at(q, i)) & (at(q, i) < F.col("_before") + F.col("_m"))
    return r.agg(*[F.max(F.when(held(q, i), F.col(c))).alias(f"q{k}_{i}") for k, q in enumerate(shares) for i in range(3)])


def _share_without(x: np.ndarray, sorted3: np.ndarray, q: float, n: int) -> np.ndarray:
    """The percentile of the n - 1 other values, for each value x that is left out."""
    at = q * (n - 2)
    part = at - np.floor(at)
    without = lambda i: np.where(x <= sorted3[i], sorted3[i + 1], sorted3[i])
    return without(0) + part * (without(1) - without(0)) if part else without(0)


def left_one_out_ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, low: float = 1.0, high: float = 9.0) -> DataFrame:
    """Complete rows with predicted: ridge on features over their quartile range, learnt from all other rows, kept within low and high.

    Rows with a null or infinite feature or target go. A feature whose quartiles are equal is not scaled. The
    only row there is gets null. No model is fitted twice over the rows: others' moments are the totals less a
    row's own, and others' quartiles are told by where the row lies among three neighbours of a place in order,
    so the work is linear in rows but for one ranking of each feature. Moments, a row, reach the driver.
    """
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    names = [*features, target]
    t = df.dropna(subset=names)
    for c in names:
        t = t.where(finite(c))
    means = t.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).first()
    n, p = means["n"], len(features)
    if n < 2:
        return t.withColumn("predicted", F.lit(None).cast("double"))
    mean = np.array([means[f"m{i}"] for i in range(p + 1)], float)
    own = [F.col(c) - float(m) for c, m in zip(names, mean)]
    sums = t.agg(*[F.sum(own[i] * own[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p + 1)]).first()
    total = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p)], float)
    quarters = np.array([[[np.nan if v is None else v for v in list(_places(t, c, (0.25, 0.75)).first())[3 * k : 3 * k + 3]] for k in range(2)] for c in features], float)
    schema = t.withColumn("predicted", F.lit(None).cast("double")).schema

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grow = n / (n - 1)
        for part in parts:
            out = np.empty(len(part))
            for a in range(0, len(part), 4096):
                v = part[names].iloc[a : a + 4096].to_numpy(float)
                x, y = v[:, :p] - mean[:p], v[:, p] - mean[p]
                scale = np.stack([_share_without(v[:, i], quarters[i, 1], 0.75, n) - _share_without(v[:, i], quarters[i, 0], 0.25, n) for i in range(p)], axis=1)
                scale[scale == 0] = 1.0
                c = total[:, :p] - grow * x[:, :, None] * x[:, None, :]
                c = c / (scale[:, :, None] * scale[:, None, :]) + alpha * np.eye(p)
                w = np.linalg.solve(c, ((total[:, p] - grow * x * y[:, None]) / scale)[:, :, None])[:, :, 0]
                out[a : a + 4096] = mean[p] - y / (n - 1) + (w * x * grow / scale).sum(axis=1)
            yield part.assign(predicted=np.clip(out, low, high))

    return t.mapInPandas(predict, schema)


def label_scores(df: DataFrame, predicted: str, target: str, cuts: tuple[float, float] = (3.5, 6.5), near: float = 1.0) -> DataFrame:
    """One row: n, mae, rho (Spearman), acc3 (same class by ``cuts``, a cut belongs above) and acc_near, over rows that have both."""
    both = df.where(F.col(predicted).isNotNull() & F.col(target).isNotNull())
    r = ranks.ranked(ranks.ranked(both, [], predicted, "_rp"), [], target, "_rt")
    level = lambda c: (F.col(c) >= cuts[0]).cast("int") + (F.col(c) >= cuts[1]).cast("int")
    off, share = F.abs(F.col(predicted) - F.col(target)), lambda c: F.avg(c.cast("double"))
    return r.agg(F.count("*").alias("n"), F.avg(off).alias("mae"), F.corr("_rp", "_rt").alias("rho"), share(level(predicted) == level(target)).alias("acc3"), share(off <= near).alias("acc_near"))


def task_roles(df: DataFrame, task: str, test: str, tasks: tuple[str, ...] = ("T0", "T1", "T2", "T3", "T4"), first: str = "train") -> DataFrame:
    """Adds role, a row for each role a row has: the test task, the one before it for val, all before that for train.

    Where nothing comes before val, val is train too. The first task as test is its own val and all but the
    last are train, test included. ``first``: ``train``, or ``baseline-only`` or ``exclude``, which keep the first task out of train.
    """
    k = tasks.index(test)
    val = tasks[max(k - 1, 0)]
    train = (tasks[:-1] if k == 0 else tasks[: k - 1]) or (val,)
    if first in ("baseline-only", "exclude"):
        train = tuple(t for t in train if t != tasks[0])
    elif first != "train":
        raise ValueError(first)
    own = lambda t, role: F.when(F.col(task).isin(*t), role) if t else F.lit(None).cast("string")
    return df.withColumn("role", F.explode(F.array_compact(F.array(own(train, "train"), own((val,), "val"), own((test,), "test")))))


def expected_keys(checked: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct keys of ``checked``; where that table has no row at all, those of any of ``others``."""
    empty = checked.select(F.lit(1).alias("_")).limit(1).agg((F.count("*") == 0).alias("_empty"))
    rest = others[0].select(*keys)
    for o in others[1:]:
        rest = rest.union(o.select(*keys))
    rest = rest.crossJoin(F.broadcast(empty)).where("_empty").drop("_empty")  # one row
    return checked.select(*keys).union(rest).distinct()


def match_cues(rows: DataFrame, key: str, side: str, name: str, ids: str, by_signature: str) -> DataFrame:
    """Per key of sessions put together: quality and cues, from the names and participants of its left and right rows.

    Cues: exact_session_name (a name on both sides), normalized_date_group_run (put together by signature),
    participant_id_overlap. Quality: single-source, high (the first cue, or both others), medium (the second), low.
    """
    names = lambda s: F.collect_set(F.when(F.col(side) == s, F.col(name)))
    people = lambda s: F.flatten(F.collect_set(F.when(F.col(side) == s, F.col(ids))))
    g = rows.groupBy(key).agg(names("left").alias("_l"), names("right").alias("_r"), people("left").alias("_a"), people("right").alias("_b"), F.bool_or(by_signature).alias("_s"))
    same, signed, shared = F.arrays_overlap("_l", "_r"), F.coalesce("_s", F.lit(False)), F.size(F.array_intersect(F.array_compact("_a"), F.array_compact("_b"))) > 0
    cues = F.array_compact(F.array(F.when(same, "exact_session_name"), F.when(signed, "normalized_date_group_run"), F.when(shared, "participant_id_overlap")))
    quality = F.when((F.size("_l") == 0) | (F.size("_r") == 0), "single-source").when(same | (signed & shared), "high").when(signed, "medium").otherwise("low")
    return g.select(key, quality.alias("quality"), cues.alias("cues"))
