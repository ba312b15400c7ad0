"""Near-duplicates: weak hashes, hot buckets, awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.llm import near_dedup, substring_dedup
from tests.llm.test_llm import DOCS, brute_near, frame, groups_of


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_words_that_weak_hashes_confuse(spark, n):
    rows = [(1, thue_morse(n)), (2, thue_morse(n, "b", "a")), (3, thue_morse(n)), (4, " ".join(thue_morse(n) for _ in range(6))), (5, " ".join(thue_morse(n, "b", "a") for _ in range(6)))]
    assert sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows)).collect())) == brute_near(rows)
    found = substring_dedup.remove_repeats(frame(spark, rows))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    got = sorted(map(tuple, found.select("doc_id", "n_bytes", n_removed, F.size("removed"), F.sha2("kept", 256)).collect()))
    assert got == sorted(substring_dedup.brute_force(rows))


@pytest.mark.parametrize("block", [4, 1024])
def test_hot_buckets(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(17)
    words, rows = [f"w{i}" for i in range(3000)], []
    base = rng.choice(words, 120).tolist()
    for i in range(60):  # one group around a base, its members between 0.7 and 1 alike
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    for hundredths in (80, 85):
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows, False), hundredths=hundredths).collect()}
        assert got == groups_of(rows, hundredths)


def test_long_texts_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    long = " ".join(f"v{i}" for i in rng.integers(0, 10**6, 300_000))  # some 2 MB
    rows = [(1, long), (2, long + " one more"), (3, "a b c d e f"), (3, "q r s t u v"), (4, "Q r s t u v"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("Component_id", F.lit(1)).withColumn("k1", F.lit("x")).withColumn("sig", F.lit("x"))
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (5, 5), (6, 6)]


def test_previous_factors_of_any_suffix_order():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        data = [bytes(rng.choice(list(b"ab"), int(rng.integers(4, 12))).tolist()) for _ in range(n)]
        doc = rng.integers(0, 9, n)
        count = np.array([len(x) - 3 for x in data])
        span, offset, flag = substring_dedup.earlier_matches(data, doc, count, 4)
        strings = [data[s][o : o + 4] for s, o in zip(span, offset)]
        least = {}
        for x, s in zip(strings, span):
            least[x] = min(least.get(x, 99), doc[s])
        assert flag.tolist() == [least[x] < doc[s] for x, s in zip(strings, span)]


def test_substring_dedup_of_long_texts(spark):
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefghij klmnop"), 1_500_000))
    rows = [(1, long), (2, long[:700_000] + "#" + long[700_000:]), (3, "x" * 200_000), (4, "x" * 200_001), (5, None), (6, "")]
    df = frame(spark, rows, False).withColumn("Doc", F.lit("clash")).withColumn("t", F.lit(1)).withColumn("removed", F.lit(1))
    got = {r["doc_id"]: (r["n_bytes"], r["removed"], len(r["kept"])) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {1: (1_500_000, [], 1_500_000), 2: (1_500_001, [[0, 700_000], [700_001, 1_500_001]], 1), 3: (200_000, [], 200_000), 4: (200_001, [[0, 200_001]], 0), 5: (0, [], 0), 6: (0, [], 0)}
