"""Phrase collocations against brute force and SQL: small heads, few tiles, awkward tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.llm import collocations as col
from cohorta.llm import queries
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("word", F.lit("x")).withColumn("id", F.lit(1))
    return [tuple(r) for r in col.collocations(df, **how).collect()]


def made(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "b", "c", "the", "Öl", "x-y", "d\x1fd", "long" * 30, "e f"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\v", "? "]
    text = lambda: "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
    rows = [(text(), rng.choice(["en", "en", "de", None])) for _ in range(n)]
    return rows + [(None, "en"), ("", "fr"), ("...", None)] + rows[:5]


def test_against_sql(spark):
    query, sql = queries.QUERIES["op11_collocations"], queries.ORACLE_SQL["op11_collocations"]
    extra, missing, _ = differences(spark, query, sql, "/root/testdata/sf0.01")
    assert not extra and not missing, (list(extra)[:3], list(missing)[:3])


@pytest.mark.parametrize("how", [{}, {"HEAD": 4}, {"HEAD": 0}, {"HEAD_BYTES": 1, "ROW": 5, "SLICE": 64}, {"TILE": 2, "TILES": 3, "DENSE": 1, "MOST_BITS": 1 << 16, "SLICE": 200, "HELD": 50}])
def test_against_brute_force(spark, monkeypatch, how):
    """Whatever lies in the head, in dense tiles or in neither: the counts are the same."""
    for k, v in how.items():
        monkeypatch.setattr(col, k, v)
    rows = made(1, 120)
    got = mined(spark, rows, least=6, top=50)
    assert sorted(got) == sorted(col.brute_force(rows, least=6, top=50)) and got


def test_share_length_and_ties(spark):
    rows = made(2, 80) + [("p q r s t u v", "en")] * 7 + [("q r s. q r s. z z z z z z", "en")]
    for how in ({"least": 4, "share": 60, "top": 40}, {"least": 3, "longest": 2, "top": 7}, {"least": 5, "longest": 3, "top": 1}):
        assert sorted(mined(spark, rows, **how)) == sorted(col.brute_force(rows, **how))


def test_nothing_frequent(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("one two", "en")]) == []
    with pytest.raises(ValueError):
        mined(spark, [("one two", "en")], longest=6)


def test_shared_hashes_are_noticed(spark, monkeypatch):
    """Two words with one id: all is done again with other hashes."""
    monkeypatch.setattr(col, "HEAD", 0)
    true, seeds = col._hashed, []

    def poor(lang, word, seed):
        return -5 if seed == 0 else true(lang, word, seed)

    monkeypatch.setattr(col, "_hashed", poor)
    rows = made(3, 40)
    words, found = col.frequent_phrases(spark.createDataFrame(rows, "text string, lang string"), least=5)
    assert words.count() == words.select("id").distinct().count() and found and not seeds


def test_tiles_count_all_pairs():
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.3, 60_000).clip(1, 3000) | 1 << 32
    ids[rng.random(len(ids)) < 0.05] = 0
    ids[rng.random(len(ids)) < 0.01] = -77
    tiles = col.Tiles(2, None, None)
    parts = [*tiles.add(ids, np.ones(len(ids), bool)), *tiles.close()]
    assert tiles.dense
    got = {}
    for (a, b), c in parts:
        for k in zip(a.tolist(), b.tolist(), c.tolist()):
            got[k[:2]] = got.get(k[:2], 0) + k[2]
    want = col.Counter((a, b) for a, b in zip(ids.tolist(), ids[1:].tolist()) if a and b)
    assert got == dict(want)


def test_rare_phrases_of_frequent_parts_are_not_counted_by_themselves(spark, monkeypatch):
    """Both parts of most phrases of three words are frequent here, the phrases are not: few of them become rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(24)]
    rows = [(" ".join(rng.choice(words) for _ in range(60)) + ". one two three", "en") for _ in range(300)]
    made, plain = {}, col.phrase_counts

    def phrase_counts(rows, m, *a):
        out = plain(rows, m, *a)
        made[m] = out.count()
        return out

    monkeypatch.setattr(col, "phrase_counts", phrase_counts)
    words, found = col.frequent_phrases(spark.createDataFrame(rows, "text string, lang string"), least=20)
    assert made[3] == 1 == found[1].count() and made[2] > 500  # some 9,900 phrases of three words occur


@pytest.mark.parametrize("how", [{"CELL_BITS": 8, "CELL_RANGES": 2}, {"CELL_BITS": 12, "CELL_RANGES": 0, "HELD": 30, "SLICE": 64}])
def test_crowded_cells_change_no_counts(spark, monkeypatch, how):
    for k, v in how.items():
        monkeypatch.setattr(col, k, v)
    rows = made(9, 250)
    for least in (3, 300):
        assert mined(spark, rows, least=least, top=60) == col.brute_force(rows, least=least, top=60)
