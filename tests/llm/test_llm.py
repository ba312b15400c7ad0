"""The training-data operators against brute force, on small fixtures with awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.llm import decontaminate as dec
from cohorta.llm import language, near_dedup, packing, queries, secrets, shards, shingles, substring_dedup, tokens, topk, toxicity, url_filter
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def awkward(n=40, seed=3):
    """Random texts with copies, near copies, nulls, blanks, a long one and repeated rows."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(n)]
    base = " ".join(rng.choice(words, 200))
    for k in range(12):
        w = base.split()
        for i in rng.integers(0, 200, k):
            w[i] = "changed"
        texts.append("  ".join(w) + "\n")
    texts += [base, base.upper(), "", "   ", "one", "one", "ça été où", " ".join(rng.choice(words, 5000)), "x" * 300, "y" + "x" * 120]
    rows = list(enumerate(texts)) + [(1000, None), (1001, None)]
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumn("N_words", F.lit(7)).withColumn("score", F.lit("s")) if extra else df


def digest_op1(found):
    d = found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("s"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("c"))
    return sorted(map(tuple, d.collect()))


@pytest.mark.parametrize("block", [10, 1 << 24])
def test_decontaminate(spark, block):
    rows = awkward()
    items = [(1, " ".join(rows[3][1].split()[:20])), (2, "w1, w2!"), (3, None), (4, ""), (5, rows[60][1] if rows[60][1] else "w5"), (None, "one"), (1, "w9 w10")]
    got = digest_op1(dec.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block))
    known = [(i, t) for i, t in items if i is not None]
    want = dec.brute_force(rows, known)
    # An item without an id marks words and is not listed.
    assert [(g[0], g[1], g[3], g[4]) for g in got] == sorted((w[0], w[1], w[3], w[4]) for w in want)
    hits = {w[0]: w[2] for w in dec.brute_force(rows, [(i or 9, t) for i, t in items])}
    assert {g[0]: g[2] for g in got} == hits


def test_decontaminate_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert all(not r[5] for r in digest_op1(dec.decontaminate(frame(spark, awkward()), items)))
    assert dec.decontaminate(frame(spark, []), items).count() == 0


def test_cut_spans(spark):
    df = frame(spark, [(1, "Keep This, w1 W2! and this"), (2, None)], False)
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert sorted(r["text"] or "" for r in dec.cut_spans(dec.decontaminate(df, items)).collect()) == ["", "Keep This, ! and this"]


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())


@pytest.mark.parametrize("block", [3, 1024])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = awkward()
    got = sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows)).collect()))
    assert got == brute_near(rows)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    got = sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False)], key=str)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_posterior_bound():
    assert near_dedup.least_matches(0.85, 125, 1e-5) < 0.85 * 125
    assert near_dedup.least_matches(0.85, 25, 1e-5) < near_dedup.least_matches(0.85, 25, 1e-2)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 1 << 63, 200, np.uint64)))
    same = (shingles.signature(a, 750) == shingles.signature(b, 750)).mean()
    assert abs(same - 800 / 1200) < 0.06
    assert (shingles.signature(a, 750)[:125] == shingles.signature(a)).all()


@pytest.mark.parametrize("chunk", [2, 4096])
def test_substring_dedup(spark, chunk, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    rows = awkward()
    found = substring_dedup.remove_repeats(frame(spark, rows))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    got = sorted(map(tuple, found.select("doc_id", "n_bytes", n, F.size("removed"), F.sha2("kept", 256)).collect()))
    assert got == sorted(substring_dedup.brute_force(rows))


def test_substring_dedup_odd_rows(spark):
    long = "abcdefghij" * 8
    rows = [(1, long), (1, long), (None, long), (2, "é" + long)]
    got = sorted(((r["doc_id"], len(r["kept"])) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 80), (1, 80), (None, 80), (2, 2)], key=str)
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_packing_is_a_partition_of_all_ids(spark):
    rows = awkward()
    pieces = packing.pack(frame(spark, rows), window=256, shard_tokens=3000).collect()
    encode = tokens.TextIds(tokens.read_tokenizer())
    want = {i: np.array([*np.frombuffer(encode(t), encode.dtype), 2], "<u4").tobytes() for i, t in rows}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert {d: b"".join(x["ids"] for x in sorted(ps, key=lambda x: x["start"])) for d, ps in by_doc.items()} == want
    for ps in by_seq.values():
        ps.sort(key=lambda x: x["offset"])
        at = 0
        for p in ps:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_puts_like_with_like():
    same = [np.array([7, 8, 9, 10, 11] * 10 + [2], np.uint16)] * 2
    other = [np.array([100 + k] * 50 + [2], np.uint16) for k in range(6)]
    pieces = packing.pack_shard([same[0], *other, same[1]], 102)
    assert {p[0] for p in pieces if p[3] == 0} == {0, 7}


def test_token_ids_equal_the_tokenizer(spark):
    made = tokens.TextIds(tokens.read_tokenizer())
    assert made.short
    for s in ["It's  a İ test’s <|endoftext|> naïve\x85x", "don't l'été 12ab!!??", "ÀÉ ß\x00 a\x1cb", "…", "a'sb 'S", "", "x" * 2000, "é ́a"]:
        assert made(s) == np.array(made.tokenizer.encode(s, add_special_tokens=False).ids, made.dtype).tobytes(), s


def brute_secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(out))


def test_secrets(spark):
    hexes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(60)]
    rows = [(i, f"plain words of ordinary text and more of it Passwd = '{h}' then") for i, h in enumerate(hexes)]
    rows += [(100, "é AKIA" + "A1" * 9 + " secret:abc token=abcdef API_KEY=longer.value"), (101, None), (102, ""), (103, "ſecret=abcdefgh toKen=abcdefgh"), (104, "f" * 23 + " " + "0" * 24)]
    rows += [(105, "see x9f8e7d6c5b4a39281f0e9d8c7b here"), (106, "theoptimalresponsibilities areplainandordinarytext")]
    df = frame(spark, rows)
    found = {r["doc_id"]: r["secrets"] for r in secrets.scan_secrets(df, secrets.train(df)).collect()}
    for i, t in rows:
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in found[i] if s["kind"] != "markov") == brute_secrets(t), t
    assert not found[106]
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(secrets.scan_secrets(df, secrets.train(df))).collect()}
    assert masked[106] == rows[-1][1] and masked[0].endswith("[secret]' then") and masked[101] is None
    assert secrets.train(frame(spark, [(1, "nothing here")])) is None


def test_language_held_out_accuracy(spark):
    got = language.op10_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    j = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert j.where("lang = lang_pred").count() / j.count() > 0.95


def test_language_odd_rows(spark):
    rows = [(1, "hello there you all"), (2, "bonjour à tous mes amis"), (3, None), (4, "1234 --"), (5, "hello you"), (6, "日本語の文章")]
    labelled = spark.createDataFrame([("hello there you all and me", "en"), ("bonjour à tous", "fr"), (None, "xx"), ("text", None)], "text string, lang string")
    got = {r["doc_id"]: r for r in language.identify_language(frame(spark, rows), language.learn_languages(labelled)).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"], got[3]["lang_pred"], got[4]["lang_pred"]) == ("en", "fr", "und", "und")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify_language(frame(spark, rows), {}).collect()} == {"und"}


def brute_segments(s):
    """All maximal-scoring segments by the recursive definition."""
    if not s or max(s) <= 0:
        return []
    total = np.concatenate(([0.0], np.cumsum(s)))
    a, b = max(((i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda x: (total[x[1]] - total[x[0]], -(x[1] - x[0])))
    return brute_segments(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(s[b:])]


def test_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(200):
        s = rng.normal(-0.3, 1, rng.integers(1, 14)).tolist()
        assert [(a, b) for _, a, b in toxicity.segments(s)] == brute_segments(s)


@pytest.mark.parametrize("block", [3, 500_000])
def test_toxicity(spark, block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_TOKENS", block)
    rng = np.random.default_rng(2)
    plain = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choice(plain, 60).tolist()
        if i % 5 == 0:
            for k in rng.integers(0, 60, 3):
                w[k] = str(rng.choice(["nasty", "vilely", "badbad"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "!!")]
    train = spark.createDataFrame([x for x in labels if x[0] < 300], "doc_id long, toxic int")
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, train)).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels if i >= 300)
    assert got[1000] == got[1001] == got[1002] < 0.3
    none = toxicity.train(docs, train.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}


def test_url_rules_and_mining(spark):
    urls = ["http://A.org/x?k=1", "http://example.org/es/a", "http://sub.EXAMPLE.org/en/12#f", "http://example.org/en/2", "x.com/de/a", None, "http://b.com/de/a", "http://b.com/fr/", "http://org", "http://notexample.org/es/"]
    rows = list(enumerate(urls)) + [(100 + i, f"http://h{i}.com/de/{i}") for i in range(30)] + [(200 + i, f"http://h{i}.com/fr/{i}") for i in range(30)] + [(300, "http://z.net/de/9")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("Host", F.lit(1))).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow") and got[1][2:] == ("example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None) and got[6][2:] == ("com/de/", "block")
    assert got[8][:3] == ("org", "", None) and got[9][2] == "org/" and got[300][2:] == (None, "block")
    assert {r["verdict"] for r in url_filter.judge(spark.createDataFrame([(1, "http://q.net/a")], "page_id long, url string")).collect()} == {url_filter.DEFAULT}


@pytest.mark.parametrize("size", [16, 4096])
def test_top_k(spark, size):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(0, 1, (400, 8)), 1).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(1000, None), (1050, [float("nan")] * 8), (1051, [None] * 8), (1100, v[3]), (None, v[1])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, shard_rows=size).collect()))
    ok = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    want = []
    for q, x in ok:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_feistel_is_a_permutation():
    for n in (1, 2, 7, 1000, 4097):
        p = shards.feistel(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n))
    assert shards.feistel(np.arange(1000), 1000, 1).tolist() != shards.feistel(np.arange(1000), 1000, 2).tolist()


def test_shards_round_trip(spark, tmp_path):
    rows = awkward()
    df = spark.createDataFrame(rows, DOCS).coalesce(2)
    m = shards.write_shards(df, str(tmp_path), length=64, per_shard=16).collect()
    encode = tokens.TextIds(tokens.read_tokenizer())
    n = len(m)
    assert sorted(r["slot"] for r in m) == list(range(n))
    read = [s for k in range(-(-n // 16)) for s in shards.read_shard(str(tmp_path), k, length=64)]
    assert len(read) == n
    by_slot = {r["slot"]: r for r in m}
    for slot, s in enumerate(read):
        assert zlib.crc32(s.tobytes()) == by_slot[slot]["crc32"] and len(s) == by_slot[slot]["n_tokens"]
    stream = np.concatenate([read[r["slot"]] for r in sorted(m, key=lambda r: r["number"])])
    assert len(stream) == sum(len(encode(t)) // 2 + 1 for _, t in rows)
    assert [len(s) for s in shards.read_shard(str(tmp_path), 0, start=10, length=64)] == [len(s) for s in read[10:16]]
    assert shards.write_shards(spark.createDataFrame([], DOCS), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    extra, missing, _ = differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    assert not extra and not missing


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    lettered = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    kept = {r[0] for r in brute_near(lettered) if r[3]}
    clean = {r[0] for r in dec.brute_force([x for x in lettered if x[0] in kept], items) if not r[5]}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"] for p in pieces} == clean
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def groups_of(rows, hundredths):
    """(id, smallest id reachable) by brute force over five-word shingles; every text has five words or more."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [lower(t).split()]}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= hundredths * (len(sets[a]) + len(sets[b]) - common):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_dedup_stage_drops_copies_from_80(spark):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    words, rows = [f"w{i}" for i in range(5000)], []
    for k in range(30):
        w = rng.choice(words, 104).tolist()
        # 100 shingles; n at the end replaced: similarity (100 - n) / (100 + n), so 0.85, 0.82, 0.80 and 0.79.
        rows += [(10 * k + n, " ".join(w[: 104 - cut] + [f"x{k}_{n}_{i}" for i in range(cut)])) for n, cut in enumerate((0, (8, 10, 11, 12)[k % 4]))]
    df = frame(spark, rows, False)
    stays = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert stays == {i for i, r in groups_of(rows, 80).items() if i == r} != {i for i, r in groups_of(rows, 85).items() if i == r}
    assert (1 - 0.8**near_dedup.ROWS) ** (near_dedup.band_hashes(80, near_dedup.MISS) // near_dedup.ROWS) < near_dedup.MISS
    assert near_dedup.band_hashes(85, near_dedup.MISS) == shingles.HASHES


def test_language_stage_decides_by_profiles(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 800)) for _ in range(20)]
    other = "日本語の文章を書くことはとても楽しいです。" * 20
    odd = spark.createDataFrame([(10_000 + i, t, None, "s", len(t)) for i, t in enumerate([*noise, other])] + [(20_000, None, "en", "s", 0), (20_001, "12 --", "en", "s", 5)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.union(odd), SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_language_stage_without_labels_keeps_texts(spark):
    import corpus_pipeline

    rows = [(1, "hello there", None, "s", 11), (2, "12 --", None, "s", 5), (3, None, None, "s", 0), (4, "", "en", "s", 0), (5, "é", None, "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, schema), SF).collect()) == [1, 5]
    # Labelled rows that op10 would hold out teach this stage.
    df = spark.range(200).where(language.held_out(F.col("id"))).selectExpr("id AS doc_id", "'hello there you all' AS text", "'en' AS lang", "'s' AS source", "19L AS n_chars")
    assert df.count() and corpus_pipeline.language(spark, df, SF).count() == df.count()


def test_secrets_partly_covered_and_short(spark):
    hexes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(60)]
    # Keys of both cases and digits, so that these are random too.
    rng = np.random.default_rng(8)
    key = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    rows = [(i, f"plain words of ordinary text and more of it Passwd = '{h if i % 2 else key(32)}' then") for i, h in enumerate(hexes)]
    long = f"Xq7Zw9KpR2{hexes[0][:26]}Vt4Ls8MnB3"
    access = "AKIA" + "Q7" * 8 + "x9q2z7k4w8"
    rows += [(100, f"see {long} here"), (101, f"é see {access} here"), (102, "see 3f9c2b7e1d8a4f6b0c5 here"), (103, f"token={hexes[1]} of ordinary text")]
    df = frame(spark, rows, False)
    prose = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    scanned = secrets.scan_secrets(df, secrets.train(df.union(prose)))
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(scanned).collect()}
    assert masked[100] == "see [secret] here" and masked[101] == "é see [secret] here" and masked[102] == "see [secret] here"
    assert masked[103] == "[secret] of ordinary text"
    found = {r["doc_id"]: [s["kind"] for s in r["secrets"]] for r in scanned.collect()}
    assert found[100] == ["markov", "hex"] and found[101] == ["access", "markov"] and found[103] == ["assign", "hex"]


def test_url_tokens_are_whole(spark):
    deep = [(i, f"http://s{i}.example.net/{'/'.join('abcde')}/{'bad' if i % 2 else 'good'}?k1=&k2=&k3=&k4=&k5=") for i in range(400)]
    # The fixed rules label by the first 200 hosts' sixth path part, told apart nowhere else.
    rules = [("block" if i % 2 else "allow", f"s{i}.example.net", "/") for i in range(200)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(deep, "page_id long, url string"), rules=rules, support=0.3).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i, _ in deep)
    # Pages of one domain, each host alone below the support; the rest of the address tells nothing.
    spam = [(i, f"http://s{i}.{'spam.net' if i % 2 else 'fine.net'}/p") for i in range(400)]
    rules = [("block" if i % 2 else "allow", f"s{i}.{'spam.net' if i % 2 else 'fine.net'}", "/") for i in range(200)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(spam, "page_id long, url string"), rules=rules, support=0.3).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i, _ in spam)
    u = F.lit("http://x.y.example.net/a/b/c/d/e/f?k1&k2&k3&k4&k5")
    one = spark.range(1).select(url_filter.tokens(u, *url_filter.host_and_path(u)).alias("t")).first()["t"]
    assert {"domain example.net", "domain y.example.net", "domain x.y.example.net", "path5 f", "key k5", "top net", "host x.y.example.net"} <= set(one) and len(one) == 16


def test_packing_scores_every_term():
    rng = np.random.default_rng(9)
    ids = [rng.integers(10, 400, rng.integers(1, 300)).astype(np.uint16) for _ in range(60)]
    index = packing.Index(ids)
    n, mean = len(ids), np.mean([len(x) for x in ids])
    df = {t: sum(t in x for x in map(set, ids)) for t in range(400)}
    for seed in range(0, 60, 7):
        score = np.zeros(n)
        for d, x in enumerate(ids):
            for t in set(ids[seed].tolist()) & set(x.tolist()):
                tf = (x == t).sum()
                score[d] += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
        got = index.near(seed, np.array([seed]))
        want = [d for d in np.argsort(-score, kind="stable") if d != seed and score[d] > 0]
        assert set(got.tolist()) == set(want) and np.allclose(score[got], score[want], rtol=1e-4)
