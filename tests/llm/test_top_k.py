"""Top-k search: row-wise exclusion, wide numbers, copies, blocks, awkward tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5):
    ok = [(n, i, [int(np.floor(256 * c)) for c in x]) for n, (i, x) in enumerate(rows) if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for n, q, x in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i, m) for m, i, y in ok if m != n and len(x) == len(y))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i, _) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size, block", [(16, 200), (64, 1 << 20)])
def test_against_brute_force(spark, size, block):
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 3, (6, 12))
    rows = [(i, (centre[i % 6] + rng.normal(0, 0.3, 12)).tolist()) for i in range(300)]
    rows += [(0, rows[7][1]), (0, rows[0][1]), (7, rows[7][1]), (50, [1.0, 2.0]), (51, [3.0]), (100, []), (101, [])]
    rows += [(1000 + i, rows[50][1]) for i in range(120)]  # copies of a query
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("V", F.lit("clash")).withColumn("row", F.lit(0))
    assert sorted(map(tuple, topk.top_k(df, lambda i: i % 50 == 0, shard_rows=size, query_bytes=block).collect())) == brute(rows)


def test_wide_numbers(spark):
    rows = [(0, [3e6, -1e6]), (50, [2e5, 1.0]), (1, [1e6, 1e6]), (2, [1e6, 1e6 + 1 / 256]), (3, [1e6, -1e6])]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, SCHEMA), lambda i: i % 50 == 0).collect())) == brute(rows)
    for x in (1e17, 1e8):  # a component, then a score, too large
        with pytest.raises(Exception, match="too large" if x > 1e16 else "64 bits"):
            topk.top_k(spark.createDataFrame([(0, [x] * 4), (1, [x] * 4)], SCHEMA), lambda i: i % 50 == 0).collect()


def test_empty_tables(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), lambda i: i % 50 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], SCHEMA), lambda i: i % 50 == 0).count() == 0
