"""The pipeline's stages, each against brute force on its own input, at the contract's similarity of 0.8."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from cohorta.llm import decontaminate as dec
from cohorta.llm import tokens
from tests.llm.test_llm import SF, lower

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_of_groups(rows, hundredths=80):
    """Ids without a linked document of smaller id in their component."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= hundredths * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def test_stages_against_brute_force(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    out = stages["language"](spark, docs, SF)
    known = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(known) == {i for i, t in rows if t and any(map(str.isalpha, t))} and all(known[i] == t for i, t in rows if i in known)
    assert out.columns == COLUMNS

    out = stages["near_dedup"](spark, out, SF)
    single = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(single) == kept_of_groups(list(known.items())) and out.columns == COLUMNS

    out = stages["benchmarks"](spark, out, SF)
    clean = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(clean) == {r[0] for r in dec.brute_force(list(single.items()), items) if not r[5]} and out.columns == COLUMNS

    out = stages["secrets"](spark, out, SF)
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert set(masked) == set(clean) and out.columns == COLUMNS
    for i, (t, n) in masked.items():
        assert n == len(t) and (t == clean[i] or "[secret]" in t)
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t)

    encode = tokens.TextIds(tokens.read_tokenizer())
    by_doc = {}
    for p in stages["packing"](spark, out, SF).collect():
        by_doc.setdefault(p["doc_id"], []).append(p)
    for i, (t, _) in masked.items():
        ids = b"".join(p["ids"] for p in sorted(by_doc.pop(i), key=lambda p: p["start"]))
        assert ids == np.array([*np.frombuffer(encode(t), encode.dtype), 2], "<u4").tobytes()
    assert not by_doc


def test_stages_on_awkward_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    same = "some words that are here more than once to be sure of it"
    odd = spark.createDataFrame([(1, same, "en", "s", 9), (1, same, "en", "s", 9), (None, same, None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0)], docs.schema)
    odd = odd.withColumn("Score", F.lit(1.5)).withColumn("kept", F.lit("x")).withColumn("secrets", F.lit("y")).withColumn("items", F.lit(1))
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        counts[name] = out.count()
    # Without a letter no language; repeated rows of one id are one document; a null id names none and stays.
    assert counts == {"language": 3, "near_dedup": 5, "benchmarks": 5, "secrets": 5}


def test_packing_keeps_like_contents_together():
    from cohorta.llm.packing import content_key

    assert content_key(np.array([5, 5, 9, 9, 9, 1])) == content_key(np.array([9, 9, 5, 5, 9, 7])) != content_key(np.array([5, 5, 5, 9, 9]))
    assert content_key(np.array([], np.uint16)) < content_key(np.array([0], np.uint16)) < content_key(np.array([0, 0, 1], np.uint16))
