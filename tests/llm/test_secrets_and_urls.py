"""Secrets and URL rules against brute force; awkward tables; blocks."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.llm import decontaminate, secrets, url_filter
from tests.llm.test_llm import DOCS, brute_secrets, frame


def brute_ratio(rows):
    """The two models from counts of characters in tokens, spelled out."""
    inside = "A-Za-z0-9+/_="
    token, chars = re.compile(rf"[{inside}-]+"), secrets._CHARS
    count = lambda strings: Counter(p for s in strings for t in token.findall(s) for p in itertools.pairwise(f"\0{t}\0"))
    whole = count(t for _, t in rows if t)
    random = count(secrets._value(t, k, a, b) for _, t in rows if t for a, k, b in secrets.base_spans(t))
    symbols = "\0" + chars
    r = np.array([[random[a, b] for b in symbols] for a in symbols], float)
    o = np.maximum(np.array([[whole[a, b] for b in symbols] for a in symbols], float) - r, 0)
    own = (r.sum(axis=0) + 1) / (r.sum(axis=0) + 1).sum()
    p = (r + 200 * own) / (r.sum(axis=1, keepdims=True) + 200)
    q = (o + 0.5) / (o.sum(axis=1, keepdims=True) + 0.5 * len(symbols))
    return {(a, b): math.log2(p[i, j] / q[i, j]) for i, a in enumerate(symbols) for j, b in enumerate(symbols)}


def test_secrets_against_brute_force(spark):
    rng = np.random.default_rng(4)
    key = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    rows = [(i, f"ordinary words and getUserName_{i} of text token={key(30)} end{'' if i % 3 else ' ' + key(28)}") for i in range(80)]
    rows += [(80, None), (81, ""), (82, "é" + key(40)), (82, "é" + key(40)), (83, "wordy " * 200_000 + key(36)), (84, hashlib.md5(b"x").hexdigest())]
    df = frame(spark, rows).withColumn("Secrets", F.lit("clash"))
    ratio = brute_ratio(rows)
    got = {}
    for r in secrets.scan_secrets(df, secrets.train(df)).collect():
        got.setdefault(r["doc_id"], []).append([(s["kind"], s["start"], s["end"]) for s in r["secrets"]])
    for i, t in rows:
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_secrets(t).split(",") if x)]
        want = list(base)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t or ""):
            # Pairs inside the token and the one that ends it.
            bits = sum(ratio[p] for p in itertools.pairwise(m[0]))
            covered = set().union(*(range(a, b) for _, a, b in base)) if base else set()
            if bits >= secrets.BITS and bits >= secrets.BITS_EACH * len(m[0]) and not set(range(*m.span())) <= covered:
                want.append(("markov", *m.span()))
        want.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert want in got[i], (i, want, got[i])
    assert secrets.scan_secrets(frame(spark, []), None).count() == 0 and secrets.train(frame(spark, [])) is None


def brute_rules(baskets, support, confidence):
    """Association rules by counting every combination of tokens, and pruned."""
    n, count = len(baskets), Counter()
    for t, _ in baskets:
        for k in range(1, len(t) + 1):
            count.update(itertools.combinations(sorted(t), k))
    both = Counter()
    for t, v in baskets:
        for k in range(1, len(t) + 1):
            both.update((c, v) for c in itertools.combinations(sorted(t), k))
    rules = {(c, v): (m / count[c], m / n) for (c, v), m in both.items() if m >= math.ceil(support * n) and m / count[c] >= confidence}
    return {(c, v): r for (c, v), r in rules.items() if not any((d, v) in rules and rules[d, v][0] >= r[0] for d in itertools.combinations(c, len(c) - 1) if d)}


@pytest.mark.parametrize("block", [3, 50_000])
def test_url_rules_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(url_filter, "BLOCK_RULES", block)
    rng = np.random.default_rng(5)
    rules = [("block", "bad.com", "/"), ("allow", "good.com", "/")]
    urls = [f"http://{rng.choice(['s', 't'])}.{rng.choice(['bad.com', 'good.com', 'new.net'])}/{rng.choice(list('ab'))}?{rng.choice(['k', 'm'])}=1" for _ in range(300)]
    rows = [*enumerate(urls), (0, urls[0]), (900, None), (901, ""), (902, "http://" + "/".join("ab" * 50_000))]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("Mined", F.lit(1)).withColumn("TOKENS", F.lit("x"))
    # ``new.net`` takes the labels' pages' words, never its own.
    read = [(r["page_id"], r["url"], r["t"]) for r in df.select("page_id", "url", url_filter.tokens(F.coalesce("url", F.lit("")), *url_filter.host_and_path(F.col("url"))).alias("t")).collect()]
    label = lambda u: "block" if u and ".bad.com/" in u else "allow" if u and ".good.com/" in u else None
    mined = brute_rules([(t, label(u)) for _, u, t in read if label(u)], 0.05, 0.55)
    got = {(r["page_id"], r["url"]): r["verdict"] for r in url_filter.judge(df, rules=rules, support=0.05, confidence=0.55).collect()}
    for i, u, t in read:
        if i == 902:
            continue
        fits = [(c, s, len(k), v) for (k, v), (c, s) in mined.items() if set(k) <= set(t)]
        assert got[i, u] == (label(u) or (max(fits)[3] if fits else url_filter.DEFAULT)), (u, t)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty).count() == 0


def test_decontaminate_long_repeated_and_clashing(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    item = " ".join(f"w{i}" for i in range(150_000, 150_040))
    rows = [(1, words), (1, words), (2, item), (None, item), (3, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("Items", F.lit(1)).withColumn("HIT_spans", F.lit("x"))
    items = spark.createDataFrame([(7, item), (7, item), (8, None)], "item_id long, text string")
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(df, items).collect()], key=str)
    assert got == sorted([(1, 200_000, 40, ["7"], False)] * 2 + [(2, 40, 40, ["7"], True), (None, 40, 40, ["7"], True), (3, 0, 0, [], False)], key=str)


def test_a_key_of_the_fragment_is_no_key(spark):
    urls = ["http://a.b.com/x#f?y=1", "http://a.b.com/x?y=1#f?z=2", "http://a.b.com/x?y=1&w=2", "http://a.b.com/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    got = {r[0]: {t for t in r[1] if t.startswith("key ")} for r in df.select("page_id", url_filter.tokens(F.col("url"), host, path)).collect()}
    assert got == {0: set(), 1: {"key y"}, 2: {"key y", "key w"}, 3: set()}


def test_a_value_found_twice_counts_once():
    digest = hashlib.md5(b"x").hexdigest()
    access = "AKIA" + "7" * 26
    assert secrets._values(f"token={digest} and {digest}") == [digest, digest]
    assert secrets._values(f"token={access}.") == [f"{access}."] and secrets._values(access) == [access]
    assert secrets._values(f"{digest}token=abcdef") == [digest, "abcdef"] and secrets._values("no words") == []
