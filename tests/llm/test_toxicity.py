"""Toxicity: calibration, significance, signs, awkward tables; scores against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.llm import toxicity
from tests.llm.test_llm import brute_segments, frame


def texts(n=300, seed=2):
    rng = np.random.default_rng(seed)
    plain, rows, labels = [f"word{i}" for i in range(200)], [], []
    for i in range(n):
        w = rng.choice(plain, 12).tolist()
        if i % 4 == 0:
            w[3:5] = rng.choice(["nasty", "vilely", "badbad"], 2).tolist()
        else:
            w[7] = "kindly"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


@pytest.mark.parametrize("block", [5, 200_000])
def test_scores_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_TOKENS", block)
    rows, labels = texts()
    train = spark.createDataFrame(labels * 2, "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), train)
    lexicon = {bytes(r["token"]): r["score"] for r in model.lexicon.collect()}
    assert lexicon[b"nasty"] > 0 > lexicon[b"kindly"]
    more = [*rows[:40], (0, rows[0][1]), (900, None), (901, ""), (902, "!! ??"), (903, "nasty word1 " * 30_000)]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame(spark, more), model).collect()}
    for i, t in more[:-1]:
        s = []
        for w in toxicity.words_of(t):
            known = [lexicon[x] for x in (w, toxicity.prefix_of(w)) if x in lexicon]
            s.append((max(known) if known else 0.0) - toxicity.STEP)
        excess = {(a, b): max(0.0, model.decay * sum(s[a:b]) - math.log(max(model.rate * len(s), 1e-300))) for a, b in brute_segments(s)}
        x = model.weights[0] + model.weights[1] * sum(excess.values())
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-x))) < 1e-6
        assert [(p["start"], p["end"]) for p in got[i]["passages"]] == [k for k, e in sorted(excess.items()) if e >= -math.log(toxicity.SIGNIFICANT)]
    assert got[903]["score"] > 0.9 and got[900]["score"] < 0.3 and not got[902]["passages"]


def test_decay_is_the_root():
    scores, counts = np.array([2.0, 0.5, -0.1, -1.0]), np.array([1.0, 5.0, 80.0, 14.0])
    x = toxicity.decay_of(scores, counts)
    assert abs((counts / 100 * np.exp(x * scores)).sum() - 1) < 1e-6 and x > 0.01


def test_empty_and_unlabelled(spark):
    rows, labels = texts(20)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(frame(spark, rows), toxicity.train(frame(spark, rows), none)).collect()} == {0.0}
    model = toxicity.train(frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7)], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0
    clash = frame(spark, rows).withColumn("Passages", F.lit(1)).withColumn("word_scores", F.lit(2))
    assert toxicity.score_toxicity(clash, model).count() == 20
