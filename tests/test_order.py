"""Ranks, percentiles and as-of joins against plain versions: nulls, ties, few ranges, empty tables."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohorta.operators import asof, evaluate, joins, ranks


def rows(seed, n=600):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("0.5"), *map(float, range(40))]), i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 4, 256])
def test_ranks_and_percentiles(spark, monkeypatch, n):
    monkeypatch.setattr(ranks, "RANGES", n)
    data = rows(n)
    df = spark.createDataFrame(data, "k string, v double, i int")
    points = ranks.split_points(df, "v", n)
    assert len(points) <= n - 1 or not points
    pdf = pd.DataFrame(data, columns=["k", "v", "i"])
    want = pdf.groupby("k", dropna=False)["v"].rank()
    got = {r["i"]: r["r"] for r in ranks.ranked(df, ["k"], "v", "r", points).collect()}
    assert len(got) == len(data) and all((got[i] is None) == np.isnan(w) and (got[i] is None or got[i] == w) for i, w in zip(pdf["i"], want))
    p = {r["k"]: r for r in ranks.percentiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 1.0}, points).collect()}
    for k, part in pdf.groupby("k", dropna=False):
        v = part["v"].dropna()
        r = p[None if k is None or k != k else k]
        assert r["n"] == len(v) and np.allclose([r["lo"], r["mid"], r["hi"]], np.percentile(v, [10, 50, 100]))
    numbers = ranks.row_numbers(df, ["v", "i"], "place").orderBy("place").collect()
    assert [r["place"] for r in numbers] == list(range(1, len(data) + 1))
    assert [r["i"] for r in numbers] == [r[2] for r in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]


def test_tertiles_as_before(spark):
    for seed in range(3):
        df = spark.createDataFrame(rows(seed, 90), "k string, v double, i int").where("k is not null")
        old = evaluate.tertile_thresholds(df, ["k"], "v").orderBy("k").collect()
        assert ranks.tertiles(df, ["k"], "v").orderBy("k").collect() == old


def test_correlations_with_missing_values(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"x": rng.integers(0, 9, 200).astype(float), "y": rng.normal(size=200), "z": rng.normal(size=200)})
    pdf["y"] += pdf["x"]
    pdf.loc[::7, "z"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "xyz"])
    got = {(r["a"], r["b"]): r for r in ranks.correlations(df, ["z", "y", "x"]).collect()}
    assert set(got) == {("x", "y"), ("x", "z"), ("y", "z")}
    for (a, b), r in got.items():
        both = pdf[[a, b]].dropna()
        assert r["n"] == len(both) and r["pearson"] == pytest.approx(both.corr().iloc[0, 1]) and r["spearman"] == pytest.approx(both.rank().corr().iloc[0, 1])
    assert ranks.correlations(df.limit(3), ["x", "y"]).collect() == []


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, v double, i int")
    assert ranks.ranked(df, ["k"], "v", "r").count() == 0 and ranks.percentiles(df, ["k"], "v", {"m": 0.5}).count() == 0
    assert ranks.row_numbers(df, ["v"], "n").count() == 0
    left = spark.createDataFrame([("a", 5)], "k string, at long")
    none = asof.nearest(left, spark.createDataFrame([], "k string, at long, v double"), ["k"], "at", "v", 10).collect()
    assert [(r["near_at"], r["near_value"]) for r in none] == [(None, None)]


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_nearest_in_buckets(spark, bucket):
    """The same as the join that sorts whole keys, whatever the bucket."""
    rng = random.Random(bucket)
    left = spark.createDataFrame([(rng.choice("abc"), rng.randint(-50, 300), i) for i in range(300)], "k string, at long, i int")
    right = spark.createDataFrame([(k, t, float(t * 2)) for k in "ab" for t in rng.sample(range(0, 250), 20)], "k string, at long, v double")
    plain = lambda df, *c: sorted(tuple(r) for r in df.select("i", *c).collect())
    for most in (None, 5):
        old, new = joins.nearest(left, right, ["k"], "at", "v", most), asof.nearest(left, right, ["k"], "at", "v", bucket, most)
        assert plain(new, "near_at", "near_value") == plain(old, "near_at", "near_value") and len(plain(new)) == 300
    assert plain(asof.backward(left, right, ["k"], "at", ["v"], bucket), "v") == plain(joins.backward(left, right, ["k"], "at", ["v"]), "v")


def test_one_time_null_keys_and_null_times(spark):
    left = spark.createDataFrame([(None, 5, 0), ("a", None, 1), ("a", 5, 2), ("a", 9, 3)], "k string, at long, i int")
    right = spark.createDataFrame([(None, 4, 1.0), ("a", 5, 2.0), ("a", 5, 3.0), ("a", None, 9.0)], "k string, at long, v double")
    got = {r["i"]: (r["near_at"], r["near_value"]) for r in asof.nearest(left, right, ["k"], "at", "v", 2).collect()}
    assert got == {0: (4, 1.0), 1: (None, None), 2: (5, 3.0), 3: (5, 3.0)}


def test_grid(spark):
    frames = spark.createDataFrame([("a", t, float(t)) for t in (0, 11, 19, 52, 2500)], "k string, at long, v double")
    old = joins.resampled_grid(frames, ["k"], "at", "v", 2, 3).select("k", "at", "near_at", "is_missing")
    new = asof.on_grid(frames, ["k"], "at", "v", 2, 3).select("k", "at", "near_at", "is_missing")
    assert sorted(map(tuple, new.collect()), key=str) == sorted(map(tuple, old.collect()), key=str)
