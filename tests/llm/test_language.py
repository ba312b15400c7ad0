"""Language ID: letters, many languages, blocks, ties, awkward tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.llm import language
from tests.llm.test_llm import frame


def test_only_letters_make_a_language(spark):
    labelled = spark.createDataFrame([("hello there you all", "en"), ("bonjour à tous", "fr")], "text string, lang string")
    texts = ["½ 12", "²", "Ⅷ", "①", "〇", "_", "12 --", "", None, "x", "日"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(frame(spark, list(enumerate(texts))), language.learn_languages(labelled)).collect()}
    assert [k for k, v in got.items() if v == "und"] and {k for k, v in got.items() if v == "und"} == set(range(9))


def brute(texts, labelled):
    """Cosines by adding up n-gram vectors one by one."""
    made = language.Profiles()

    def bundle(t):
        s = [0]
        for c in t.lower():
            c = ord(c) if c.isalpha() else 0
            if c or s[-1]:
                s.append(c)
        s = s + [0] if s[-1] or len(s) == 1 else s + [0]
        v = np.zeros(language.DIM)
        for a, b, c in zip(s, s[1:], s[2:]):
            v += np.roll(made.letter(a), 2).astype(float) * np.roll(made.letter(b), 1) * made.letter(c)
        return v / np.linalg.norm(v)

    total = {}
    for t, g in labelled:
        total[g] = total.get(g, 0) + bundle(t)
    names = sorted(total)
    table = np.stack([total[g] / np.linalg.norm(total[g]) for g in names])
    out = {}
    for i, t in texts:
        cos = table @ bundle(t)
        out[i] = (names[int(cos.argmax())], float(cos.max()), float(np.exp(12 * cos.max()) / np.exp(12 * cos).sum()))
    return out


@pytest.mark.parametrize("block", [2, 4096])
def test_against_brute_force_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", block)
    rng = np.random.default_rng(3)
    sounds = ["abcde", "efghi", "ijklm", "日本語文章", "мнопр", "xyzqw", "rstuv"]
    say = lambda k: " ".join("".join(rng.choice(list(sounds[k]), 4)) for _ in range(8))
    labelled = [(say(k), f"l{k}") for k in range(7) for _ in range(3)] * 2
    texts = [(i, say(i % 7)) for i in range(30)] + [(30, "a" * 500_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("Score", F.lit("s")).withColumn("lang", F.lit(None).cast("string"))
    learnt = language.learn_languages(spark.createDataFrame(labelled, "text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["lang_cosine"], r["score"]) for r in language.identify_language(df, learnt).collect()}
    want = brute(texts, labelled)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert np.allclose([got[i][1:] for i in range(31)], [want[i][1:] for i in range(31)], atol=1e-4)


def test_ties_and_empty_tables(spark):
    same = spark.createDataFrame([("aaa bbb", "z"), ("aaa bbb", "b"), ("aaa bbb", "b")], "text string, lang string")
    learnt = language.learn_languages(same)
    rows = language.identify_language(frame(spark, [(1, "aaa bbb"), (1, "aaa bbb")]), learnt).collect()
    assert [r["lang_pred"] for r in rows] == ["b", "b"] and all(abs(r["score"] - 0.5) < 1e-6 for r in rows)
    assert language.identify_language(frame(spark, []), learnt).count() == 0
    assert language.learn_languages(same.where("lang = 'none'")).count() == 0
    assert language.known_language(spark.createDataFrame([], "text string, lang string")).count() == 0
