"""Quality rules: base figures and decoding against brute force, likelihood against enumeration, held-out accuracy."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohorta.llm import quality as q

SF = "/root/testdata/sf0.01"


def base_rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("N_Words", F.lit("x")).withColumn("content", F.lit(1))
    return {r["doc_id"]: tuple(r[c] for c in q.BASE) for r in q.mark_lines(df, None).select("doc_id", *q.BASE).collect()}


def test_base_figures(spark):
    rng = random.Random(12)
    words = ["a", "b", "#", "é|", "c.", "\x1f", "<d>", "\xa0", "long" * 9]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "\r\n", "\v", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " \n\t", "\n" * 5, "x", "x y z x y z", "x y z z y x", "same line\nsame line\n same line", "w " * 300_000, " ".join(map(str, range(100_000)))]
    assert base_rows(spark, texts) == {i: q.brute_base(t) for i, t in enumerate(texts)}
    assert base_rows(spark, []) == {}


def test_many_words_need_no_wider_numbers():
    words = [b"%d" % i for i in range(1_700_000)] + [b"1", b"2", b"3"]
    assert q.repeated_words(words).nonzero()[0].tolist() == [1, 2, 3, 1_700_000, 1_700_001, 1_700_002]


def paths(n):
    return itertools.product((0, 1), repeat=n)


def total(field, traits, path):
    s = sum(field.weights[t].sum() for t, y in zip(traits, path) if y)
    return s + sum(field.pairs[a, b] for a, b in itertools.pairwise(path))


def test_viterbi_and_marginals_against_all_paths():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7):
        field = q.Field(rng.normal(size=q.FIRST[-1]), rng.normal(size=(2, 2)) * 2)
        traits = np.stack([rng.integers(a, b, n) for a, b in itertools.pairwise(q.FIRST)], axis=1)
        best = max(paths(n), key=lambda y: total(field, traits, y))
        assert field.labels(traits).astype(int).tolist() == list(best)
        mass = {y: math.exp(total(field, traits, y)) for y in paths(n)}
        z = sum(mass.values())
        one, pairs = q.Field._marginals(field.weights[traits].sum(axis=1), field.pairs, np.array([0]), [1] * n)
        assert np.allclose(one, [sum(m for y, m in mass.items() if y[k]) / z for k in range(n)])
        want = np.zeros((2, 2))
        for y, m in mass.items():
            for a, b in itertools.pairwise(y):
                want[a, b] += m / z
        assert np.allclose(pairs, want)
    assert q.Field().labels(np.zeros((0, len(q.LEVELS)), int)).tolist() == []
    assert q.Field().labels(traits).all()  # ties go to content


def test_fit_finds_persistent_labels():
    """Chains whose labels persist, and traits that tell little: neighbours must decide."""
    rng = np.random.default_rng(4)
    sizes, labels = np.full(300, 12), []
    for _ in sizes:
        y = [int(rng.random() < 0.5)]
        while len(y) < 12:
            y.append(y[-1] if rng.random() < 0.95 else 1 - y[-1])
        labels += y
    labels = np.array(labels)
    traits = np.stack([np.where((labels == 1) ^ (rng.random(len(labels)) < 0.3), a, a + 1) if k == 0 else np.full(len(labels), a) for k, a in enumerate(q.FIRST[:-1])], axis=1)
    field, true = q.Field().fit(traits, labels, sizes, chain=True), q.Field()
    true.weights[q.FIRST[0] : q.FIRST[0] + 2] = math.log(7 / 3), -math.log(7 / 3)
    true.pairs = np.log([[0.95, 0.05], [0.05, 0.95]])
    right = lambda f: (np.concatenate([f.labels(traits[k : k + 12]) for k in range(0, len(labels), 12)]) == labels).mean()
    assert right(field) > right(true) - 0.02 > ((traits[:, 0] == q.FIRST[0]) == labels).mean() + 0.05
    assert field.pairs[0, 0] + field.pairs[1, 1] > field.pairs[0, 1] + field.pairs[1, 0]


def test_held_out_accuracy(spark):
    """Fitted on four fifths of the labels, it rejects bad texts of the last fifth and keeps good ones."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fifth = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    found = q.judged(q.mark_lines(docs.where(fifth), q.learn_field(docs, labels.where(~fifth)))).join(labels, "doc_id")
    rows = found.select("quality", "base_failed", "kept").collect()
    good, bad = [r for r in rows if r[0] == 1 and not r[1]], [r for r in rows if r[0] == 0]
    assert sum(r[2] for r in good) >= 0.97 * len(good) and good
    assert sum(r[2] for r in bad) <= 0.1 * len(bad) and bad


def test_content_beside_boilerplate(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    prose = next(r["text"] for r in docs.join(labels.where("quality = 1"), "doc_id").where("n_chars between 800 and 3000").orderBy("doc_id").collect())
    menu = "home | news | terms | login | help | about | jobs | press\n" * 3
    df = spark.createDataFrame([(1, prose), (2, menu * 40), (3, menu + prose)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in q.judged(q.mark_lines(df, q.learn_field(docs, labels))).collect()}
    assert rows[1]["kept"] and rows[1]["content_words"] == rows[1]["n_words"]
    assert not rows[2]["kept"] and rows[2]["content_words"] == 0
    assert rows[3]["kept"] and not any(rows[3]["content"][:3])


def test_nothing_to_learn_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words " * 40, "x"), (None, None, "y"), (1, "some words " * 40, "x")], "doc_id long, text string, kept string")
    for labels in ([], [(1, 1, 0), (1, 1, 0)], [(1, None, 0), (None, 0, 0)], [(1, 0, 0)]):
        assert q.learn_field(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) is None
    out = q.judged(q.mark_lines(docs, None))
    assert len(out.columns) == len({c.lower() for c in out.columns}) and out.count() == 3
    assert q.learn_field(docs.limit(0), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")) is None


def test_query(spark):
    rows = q.op12_quality_rules(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = q.brute_base(texts[r["doc_id"]])
        assert tuple(r[c] for c in q.BASE) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r["kept"] and r["base_failed"])


def test_lines_of_empty_arrays():
    assert q.Lines(pa.array([], pa.string())).sizes.tolist() == []
    assert q.Lines(pa.array([None, "", "\n"], pa.string())).sizes.tolist() == [0, 0, 0]
