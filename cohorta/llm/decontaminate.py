"""Benchmark decontamination: which documents repeat windows of test items.

A broadcast hash set of normalised test n-grams; every document's token windows are
looked up, hits are verified token by token, and spans or documents are removed.

* Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
* A window is ``ngram`` consecutive words of an item; a shorter item with any word is
  one window. Every document word inside an occurrence of a window is hit.
* Null or empty texts have no words; null items and items without words have no window;
  an item without an id marks words but is never listed. Repeated items count once.
* An empty benchmark leaves every document clean.
* Input columns are kept; a result column takes the place of an input column of its name.

The benchmark is sent to the executors in blocks of at most ``BLOCK_BYTES`` of text. Each block
is a pass over the documents, and what a pass has found is written before the next block is
sent: one block is alive at a time, and no shuffle is needed. One block needs no writing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta.llm.common import LOWER, bounded_batches, concat_ranges, discard, kept, lean, mix, staged, text_bytes

NGRAM = 13
#: Most bytes of benchmark text in one broadcast.
BLOCK_BYTES = 16 << 20
_WORD_BYTE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER)
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTE).split() if text else []


class Windows:
    """The windows of some test items, with exact lookup: all words as one array of numbers, windows as places in it."""

    def __init__(self, items: list[tuple[object, str]], ngram: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [None if item_id is None else str(item_id) for item_id, _ in items]
        words, sizes = array("i"), []
        for _, text in items:
            own = words_of(text)
            words.extend(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own)
            sizes.append(len(own))
        self.words = np.array(words, np.int32)
        size = np.array(sizes, np.int64)
        first, length = np.cumsum(size) - size, np.minimum(size, ngram)
        self.by_length = [self._sorted(n, np.flatnonzero(length == n), first, size) for n in np.unique(length[length > 0]).tolist()]

    def keys(self, place: np.ndarray, n: int, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.uint64)
        for low in range(0, len(place), 1 << 18):
            part = out[low : low + (1 << 18)]
            for j in range(n):
                part = mix(part + words[place[low : low + (1 << 18)] + j].astype(np.uint64) + np.uint64(j + 1))
            out[low : low + (1 << 18)] = part
        return out

    def _same(self, words: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether ``n`` words from ``a`` in ``words`` are those from ``b`` in the items."""
        out = np.ones(len(a), bool)
        for j in range(n):
            out &= words[a + j] == self.words[b + j]
        return out

    def _sorted(self, n: int, items: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple:
        """n, keys in order, of each key a window's place, where its items begin, the items, and the words that begin a window."""
        count = size[items] - n + 1
        place, item = concat_ranges(first[items], count), np.repeat(items, count).astype(np.int32)
        key = self.keys(place, n, self.words)
        order = np.lexsort((item, key))
        key, place, item = key[order], place[order], item[order]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & self._same(self.words, place[1:], place[:-1], n)
        new = np.ones(len(key), bool)
        new[1:] = ~(again[1:] & (item[1:] == item[:-1]))  # a window that an item repeats counts once
        key, place, item, again = key[new], place[new], item[new], again[new]
        head = np.flatnonzero(~again)
        begins = np.zeros(len(self.vocabulary), bool)
        begins[self.words[place[head]]] = True
        return n, key[head], place[head], np.append(head, len(item)), item, begins

    def find(self, ids: np.ndarray):
        """Of each window length: n, the places in ``ids`` (-1: no word of a test), the windows there, and what lists their items."""
        known = ids >= 0
        if not known.any():
            return
        place = np.arange(len(ids))
        stop = np.where(known, len(ids), place)
        run = np.minimum.accumulate(stop[::-1])[::-1] - place
        for n, key, window, begin, item, begins in self.by_length:
            at = np.flatnonzero(run >= n)
            at = at[begins[ids[at]]]
            k = self.keys(at, n, ids)
            low, high = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
            at, found = np.repeat(at, high - low), concat_ranges(low, high - low)
            same = self._same(ids, at, window[found], n)  # the hit is verified word by word
            yield n, at[same], found[same], (begin, item)

    def listed(self, window: int, lists: tuple) -> list[str]:
        begin, item = lists
        return [self.names[i] for i in item[begin[window] : begin[window + 1]].tolist() if self.names[i] is not None]


def _scan(windows: Windows, raw: bytes, start: np.ndarray, end: np.ndarray):
    """Of each row: its number of words, its hit words as a mask, its items."""
    get = windows.vocabulary.get
    per_row, flat = [], []
    for a, b in zip(start.tolist(), end.tolist()):
        words = raw[a:b].split()
        per_row.append(len(words))
        flat += [get(w, -1) for w in words]
        flat.append(-1)
    n_words = np.array(per_row, np.int64)
    first = np.cumsum(n_words + 1) - (n_words + 1)
    ids = np.array(flat, np.int64) if flat else np.zeros(0, np.int64)
    delta = np.zeros(len(ids) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for n, at, found, lists in windows.find(ids):
        np.add.at(delta, at, 1)
        np.add.at(delta, at + n, -1)
        row = np.searchsorted(first, at, "right") - 1
        for r, w in np.unique(np.stack((row, found), axis=1), axis=0).tolist() if len(at) else ():
            items.setdefault(r, set()).update(windows.listed(w, lists))
    return n_words, first, np.cumsum(delta[:-1]) > 0, items


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _blocks(benchmark: DataFrame, most: int):
    """The items in lists of at most ``most`` bytes of text (one item at least)."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        n = len(r["text"].encode())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, ngram: int = NGRAM, share: float = 0.05, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, hit_spans (words, end exclusive), n_hit, items (sorted ids), contaminated.

    contaminated: some word is hit and at least ``share`` of the words are.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    added = T.StructType().add("n_words", "long").add("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))).add("items", T.ArrayType(T.StringType()))
    own = {f.name for f in added} | {"n_hit", "contaminated"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own])
    out = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("hit_spans", F.lit(None).cast(added["hit_spans"].dataType)).withColumn("items", F.lit(None).cast(added["items"].dataType))
    schema, before = out.schema, None
    for block in _blocks(benchmark, block_bytes):
        if before is not None:
            old, out = out, staged(before, "scanned")
            if hasattr(old, "staged_at"):
                discard(old)
            sent.unpersist()
        sent = spark.sparkContext.broadcast(block)

        def scan(batches, sent=sent, name=uuid.uuid4().hex):
            windows = kept(("windows", name), lambda: Windows(sent.value, ngram))  # once a worker, whatever its tasks
            for batch in batches:
                raw, start, end = text_bytes(batch.column("text"))
                raw = raw.tobytes().translate(_WORD_BYTE)
                old_spans, old_items = batch.column("hit_spans").to_pylist(), batch.column("items").to_pylist()
                counts, spans, items = [], [], []
                for low in range(0, len(start), 512):
                    n, first, hit, found = _scan(windows, raw, start[low : low + 512], end[low : low + 512])
                    for r in range(len(n)):
                        i = low + r
                        mask = hit[first[r] : first[r] + n[r]]
                        if old_spans[i]:
                            mask = mask.copy()
                            for a, b in old_spans[i]:
                                mask[a:b] = True
                        counts.append(int(n[r]))
                        spans.append(_runs(mask) if mask.any() else [])
                        items.append(sorted({*found.get(r, ()), *(old_items[i] or ())}))
                own = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
                own |= {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(own)

        before = out.mapInArrow(lean(scan), schema)
    out = before
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words")))


def cut_spans(flagged: DataFrame) -> DataFrame:
    """Removes each hit span, from its first word's first to its last word's last letter, from text.

    Takes what ``decontaminate`` gives; null stays null.
    """

    @F.pandas_udf("string")
    def cut(text, spans):
        out = []
        for t, runs in zip(text, spans):
            if t is not None and runs is not None and len(runs):
                at = [m.span() for m in _WORDS.finditer(t)]
                for a, b in reversed([tuple(x) for x in runs]):
                    t = t[: at[a][0]] + t[at[b - 1][1] :]
            out.append(t)
        import pandas as pd

        return pd.Series(out, dtype=object)

    return flagged.withColumn("text", F.when(F.size("hit_spans") > 0, cut("text", "hit_spans")).otherwise(F.col("text")))


def remove_documents(flagged: DataFrame) -> DataFrame:
    return flagged.where(~F.col("contaminated"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: contaminated is exact in integers (20 * n_hit >= n_words)."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """The same digest by looking at every window of every document; for small inputs."""
    windows: dict[tuple, set[str]] = {}
    for item_id, text in items:
        w = _WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        n = min(NGRAM, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item_id))
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w = _WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= names
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out
