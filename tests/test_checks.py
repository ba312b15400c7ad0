"""Checks of labels and matches against fits and sets spelled out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.operators import checks


@pytest.mark.parametrize("n", [2, 3, 4, 7, 30])
def test_left_out_ridge_equals_fits(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 2)) * [3, 0.5], 1)  # ties
    x[:, 1] = 0.5 if n == 7 else x[:, 1]  # no spread: not scaled
    y = np.round(5 + x[:, 0] + rng.normal(size=n), 2)
    rows = [(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))] + [(90, None, 1.0, 2.0), (91, float("inf"), 1.0, 2.0), (92, 1.0, float("nan"), 2.0), (93, 1.0, 1.0, None)]
    got = {r["i"]: r["predicted"] for r in checks.left_one_out_ridge(spark.createDataFrame(rows, "i int, a double, b double, y double"), ["a", "b"], "y", 0.7, 2.0, 8.0).collect()}
    assert set(got) == set(range(n))
    for i in range(n):
        o = np.arange(n) != i
        s = np.percentile(x[o], 75, axis=0) - np.percentile(x[o], 25, axis=0)
        s[s == 0] = 1.0
        z = (x - x[o].mean(axis=0)) / s
        w = np.linalg.solve(z[o].T @ z[o] + 0.7 * np.eye(2), z[o].T @ (y[o] - y[o].mean()))
        assert got[i] == pytest.approx(np.clip(y[o].mean() + z[i] @ w, 2.0, 8.0), abs=1e-9)
    one = spark.createDataFrame([(1, 1.0, 2.0)], "i int, a double, y double")
    assert checks.left_one_out_ridge(one, ["a"], "y").first()["predicted"] is None and checks.left_one_out_ridge(one.where("i > 1"), ["a"], "y").count() == 0


def test_label_scores(spark):
    r = checks.label_scores(spark.createDataFrame([(3.5, 4.0), (6.4, 6.5), (1.0, 1.0), (9.0, 7.9), (None, 1.0), (1.0, None)], "p double, y double"), "p", "y").first()
    assert (r["n"], r["acc3"], r["acc_near"]) == (4, 0.75, 0.75) and r["mae"] == pytest.approx((0.5 + 0.1 + 0 + 1.1) / 4) and r["rho"] == pytest.approx(1.0)


def test_roles_keys_and_cues(spark):
    d = spark.createDataFrame([(f"T{i}",) for i in range(5)] + [(None,)], "task string")
    role = lambda test, first="train": {k: sorted(r["task"] for r in checks.task_roles(d, "task", test, first=first).where(F.col("role") == k).collect()) for k in ("train", "val", "test")}
    assert role("T4") == {"train": ["T0", "T1", "T2"], "val": ["T3"], "test": ["T4"]} and role("T2", "baseline-only") == {"train": [], "val": ["T1"], "test": ["T2"]}
    assert role("T1") == {"train": ["T0"], "val": ["T0"], "test": ["T1"]} and role("T0") == {"train": ["T0", "T1", "T2", "T3"], "val": ["T0"], "test": ["T0"]}
    with pytest.raises(ValueError):
        checks.task_roles(d, "task", "T4", first="other")
    k = lambda *v: spark.createDataFrame([(x, 1) for x in v], "k string, more int")
    rows = lambda df: sorted(r["k"] for r in df.collect())
    assert rows(checks.expected_keys(k("a", "a"), [k("b")], ["k"])) == ["a"] and rows(checks.expected_keys(k("a").where("more > 1"), [k("b", "b"), k("c", "b")], ["k"])) == ["b", "c"]
    m = [("x", "left", "n", ["p"], False), ("x", "right", "n", ["q"], False), ("y", "left", "n", ["p"], True), ("y", "right", "o", ["p", None], True), ("z", "left", "n", None, True), ("z", "right", "o", ["p"], True), ("w", "left", "n", ["p"], None), ("v", "left", "n", ["p"], False), ("v", "right", "o", ["p"], False)]
    got = {r["k"]: (r["quality"], r["cues"]) for r in checks.match_cues(spark.createDataFrame(m, "k string, side string, name string, ids array<string>, s boolean"), "k", "side", "name", "ids", "s").collect()}
    assert got == {"x": ("high", ["exact_session_name"]), "y": ("high", ["normalized_date_group_run", "participant_id_overlap"]), "z": ("medium", ["normalized_date_group_run"]), "w": ("single-source", []), "v": ("low", ["participant_id_overlap"])}
