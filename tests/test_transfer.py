"""Labels by the similarity of all training subjects, in blocks, against single pairs."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.operators import evaluate


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size > 0 else 0.0


@pytest.mark.parametrize("sizes", [(2048, 4096), (3, 4), (1, 1)])
def test_against_single_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(evaluate, "TEST_BLOCK", sizes[0])
    monkeypatch.setattr(evaluate, "TRAIN_BLOCK", sizes[1])
    rng = random.Random(3)

    def vector():
        kind = rng.random()
        return None if kind < 0.1 else [0.0] * 3 if kind < 0.2 else [1.0, None, 2.0] if kind < 0.3 else [rng.uniform(-1, 1) for _ in range(2 if kind < 0.4 else 3)]

    vectors = {s: vector() for s in "abcdefghijklmn"}
    train = [(k, s, vectors[s], None if s == "c" else float(rng.randint(1, 9))) for k in (1, 2) for s in "abcdefgh" for _ in range(rng.randint(1, 2))] + [(3, "a", [1.0], 2.0), (4, "z", [1.0], None)]
    test = [(k, s, vectors[s]) for k in (1, 2) for s in "abghijklmn"] + [(3, "a", [1.0]), (4, "y", [1.0]), (5, "y", [1.0]), (1, None, [1.0])]
    want = {}
    for k, s, v in test:
        w = {o: max(cosine(v, u) if cosine(v, u) is not None else 0.05, 0.05) for kk, o, u, _ in train if kk == k and o != s and s is not None}
        y = {o: [r[3] for r in train if r[:2] == (k, o) and r[3] is not None] for o in w}
        if w:
            want[s, k] = sum(w[o] * np.mean(y[o]) for o in w if y[o]) / sum(w.values()) if any(y.values()) else None
    a = spark.createDataFrame(test, "stimulus int, subject string, traits array<double>")
    b = spark.createDataFrame(train, "stimulus int, subject string, traits array<double>, y double")
    rows = evaluate.weighted_transfer(a, b, "stimulus", "subject", "traits", "y").collect()
    assert len(rows) == len(want) and {(r["subject"], r["stimulus"]): r["label"] for r in rows} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_all_pairs_of_one_stimulus_in_time(spark):
    """1,000 x 20,000 pairs as products of matrices; one row a pair took minutes."""
    v = spark.range(21_000).select("id", F.lit(1).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sin(F.col("id") * i)).alias("v"), (F.col("id") % 9).alias("y"))
    start = time.time()
    rows = evaluate.weighted_transfer(v.where("id < 1000").drop("y"), v.where("id >= 1000"), "k", "id", "v", "y").collect()
    assert len(rows) == 1000 and time.time() - start < 40
    e = np.sin(np.arange(21_000)[:, None] * np.arange(1, 17))
    r = next(r for r in rows if r["id"] == 7)
    w = np.maximum(e[1000:] @ e[7] / np.linalg.norm(e[1000:], axis=1) / np.linalg.norm(e[7]), 0.05)
    assert r["label"] == pytest.approx((w * (np.arange(1000, 21_000) % 9)).sum() / w.sum())
