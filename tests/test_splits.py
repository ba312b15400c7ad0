"""Splits by subject, greedy folds against a loop over groups, residuals against least squares."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from cohorta.operators import splits


def test_every_subject_in_every_part(spark):
    rows = [(s, i) for s, n in ((1, 1), (2, 2), (3, 3), (4, 5), (None, 12), (6, 400)) for i in range(n)]
    df = spark.createDataFrame(rows, "s int, i int")
    by = lambda d: {s: Counter(r["role"] for r in d if r["s"] == s) for s in (1, 2, 3, 4, None, 6)}
    a = splits.subject_windows_split(df, "s", ["i"]).collect()
    want = {}
    for s, n in ((1, 1), (2, 2), (3, 3), (4, 5), (None, 12), (6, 400)):
        t = v = max(1, round(n * 0.2))
        if t + v >= n:
            t, v = 1, int(n > 1)
        want[s] = {"test": t, "val": v, "train": n - t - v}
    assert by(a) == {s: {k: v for k, v in w.items() if v} for s, w in want.items()} and len(a) == len(rows)
    b = by(splits.stratified_split(df, "s", ["i"]).collect())
    assert b[1] == {"train": 1} and b[2] == {"train": 2} and b[3] == {"test": 1, "val": 1, "train": 1} and b[6] == {"test": 60, "val": 60, "train": 280}
    assert set(a) == set(splits.subject_windows_split(df, "s", ["i"]).collect())
    other = splits.subject_windows_split(df, "s", ["i"], seed=7).collect()
    assert {tuple(r) for r in other} != {tuple(r) for r in a}
    numbers = splits.seeded_numbers(df, ["s"], ["i"], 1).where("s = 6").orderBy("_r").collect()
    assert [r["_r"] for r in numbers] == list(range(1, 401)) and [r["i"] for r in numbers] != list(range(400))


def greedy(sizes, k):
    """Each group by itself, in falling size, to the fold of fewest rows."""
    load, out = [0] * k, {}
    for size, many in sorted(sizes, reverse=True):
        for i in range(many):
            f = load.index(min(load))
            load[f] += size
            out[size, i] = f
    return out, load


@pytest.mark.parametrize("k", [1, 2, 5, 7])
def test_phases_are_the_greedy_rule(k):
    rng = random.Random(k)
    for _ in range(60):
        sizes = [(s, rng.randint(1, 40)) for s in rng.sample(range(1, 60), rng.randint(1, 6))]
        want, _ = greedy(sizes, k)
        got = {(size, i): folds[(i - a) % len(folds)] for size, a, b, folds in splits.fold_phases(sizes, k) for i in range(a, b)}
        assert got == want
    assert len(splits.fold_phases([(10**9, 1), (1, 10**9)], 5)) < 20  # a hot group and very many small ones


def test_group_folds(spark):
    rng = random.Random(3)
    rows = [(g, i) for g in [None, *range(40)] for i in range(rng.choice([1, 1, 2, 3, 9]))] + [(99, i) for i in range(150)]
    out = splits.balanced_group_folds(spark.createDataFrame(rows, "g int, i int"), "g", 4).collect()
    assert len(out) == len(rows) and len({(r["g"], r["fold"]) for r in out}) == 42
    size = Counter(r[0] for r in rows)
    _, load = greedy(list(Counter(size.values()).items()), 4)
    assert sorted(Counter(r["fold"] for r in out).values()) == sorted(x for x in load if x)
    f = spark.createDataFrame([(r["g"], r["fold"], r["i"]) for r in out], "g int, fold int, i int")
    from pyspark.sql import functions as F

    fitted = {r["fold"]: r["n"] for r in splits.refitted(f, "fold", lambda d, keys: d.groupBy(*keys).agg(F.count("*").alias("n")), []).collect()}
    assert fitted == {k: len(rows) - v for k, v in Counter(r["fold"] for r in out).items()}


@pytest.mark.parametrize("covariates", [["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "twice"]])
def test_residuals_are_those_of_least_squares(spark, covariates):
    rng = np.random.default_rng(len(covariates))
    n = 120
    pdf = pd.DataFrame({"k": rng.integers(0, 3, n), "a": rng.normal(size=n), "b": rng.normal(size=n) * 100, "c": rng.normal(size=n)})
    pdf["twice"] = 2 * pdf["a"]
    pdf["x"] = pdf["a"] - pdf["b"] / 50 + rng.normal(size=n) + 1000
    pdf["y"] = pdf["x"] + pdf["c"] + rng.normal(size=n)
    pdf.loc[::9, "b"] = np.nan
    pdf = pd.concat([pdf, pd.DataFrame({"k": [9] * 3, "a": [1.0, 2, 3], "b": 1.0, "c": 1.0, "twice": 2.0, "x": 1.0, "y": 2.0})], ignore_index=True)
    pdf["i"] = range(len(pdf))
    df = spark.createDataFrame(pdf)
    got = {r["k"]: r for r in splits.partial_correlations(df, ["k"], "x", "y", covariates).collect()}
    left = {r["i"]: r["residual"] for r in splits.residuals(df, ["k"], "x", covariates).collect()}
    assert set(got) == {0, 1, 2}
    for k in got:
        part = pdf[pdf["k"] == k].dropna(subset=["x", "y", *covariates])
        z = np.column_stack([np.ones(len(part)), part[covariates]])
        rest = {c: part[c] - z @ np.linalg.lstsq(z, part[c], rcond=None)[0] for c in "xy"}
        assert got[k]["n"] == len(part) and got[k]["r"] == pytest.approx(np.corrcoef(rest["x"], rest["y"])[0, 1], abs=1e-7)
        assert np.allclose([left[i] for i in part["i"]], rest["x"], atol=1e-6)
    flat = spark.createDataFrame([(1, float(i), 5.0, float(i % 3)) for i in range(20)], "k int, x double, y double, a double")
    assert [r["r"] for r in splits.partial_correlations(flat, ["k"], "x", "y", ["a"]).collect()] == [None]


def test_task_roles(spark):
    df = spark.createDataFrame([(t, i) for t in (0, 1, 2, 3, 4, None) for i in range(2)], "task int, i int")
    roles = lambda *how: Counter((r["task"], r["role"]) for r in splits.task_roles(df, "task", [0, 1, 2, 3, 4], *how).collect())
    assert roles(3) == {(0, "train"): 2, (1, "train"): 2, (2, "val"): 2, (3, "test"): 2}
    assert roles(3, "exclude") == {(1, "train"): 2, (2, "val"): 2, (3, "test"): 2}
    assert roles(3, "baseline-only") == {(0, "baseline"): 2, (1, "train"): 2, (2, "val"): 2, (3, "test"): 2}
    assert roles(1) == {(0, "train"): 2, (0, "val"): 2, (1, "test"): 2}
    for bad in ((0,), (2, "other")):
        with pytest.raises(ValueError):
            roles(*bad)


def test_subject_folds_against_copies(spark):
    rng = random.Random(5)
    rows = [(s, t, rng.choice([None, 1.0, 2.0, 5.0])) for s in "abc" for t in (0, 1, 2, 3) for _ in range(rng.randint(0, 3)) if (s, t) != ("a", 3)] + [("d", 3, 1.0), ("d", 2, 3.0)]
    df = spark.createDataFrame(rows, "s string, t int, x double")
    for test in (3, None):
        got = {(r["fold"], r["role"]): (r["n"], r["mean"]) for r in splits.subject_folds(df, "s", "t", "x", [0, 1], 2, 1, test).collect()}
        want = {}
        for s in "abcd":
            own = [r for r in rows if r[0] == s and test in (None, r[1])]
            rest = [r for r in rows if r[0] != s]
            if own:
                val = [r for r in rest if r[1] == 2] or [r for r in rest if r[1] == 1]
                for role, part in (("train", [r for r in rest if r[1] < 2]), ("val", val), ("test", own)):
                    x = [r[2] for r in part if r[2] is not None]
                    want[s, role] = (len(part), pytest.approx(sum(x) / len(x)) if x else None)
        assert got == want
