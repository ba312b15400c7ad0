"""Suffix-order deduplication: later copies of long byte strings go, the first one stays.

A byte is removed if a string of ``LEAST`` bytes that covers it also starts in a document of
smaller id. What decides is, for each start, whether its longest previous factor (the
longest match that starts in an earlier document) has ``LEAST`` bytes. In suffix order
the longest match with an earlier document stands at the previous or at the next smaller
position, a position's value being its document; factors are cut off at ``LEAST``, so
both are searched only within a run of suffixes whose common prefixes reach it.

No suffix array spans the corpus. Each ``LEAST``-byte string is dealt by an anchor that
its own bytes determine: the least hash of its ``GRAM``-byte substrings. So equal strings
always meet in one shard, and consecutive starts with one anchor travel as one span.

1. A pass finds anchors that occur in two documents and marks them in a bit set of fixed
   size; the second pass lets only spans with a marked anchor through (some others too).
2. Equal spans stand for one: they are aggregated (map-side, by a 96-bit cryptographic hash
   of their bytes) to their first document, and every start of a later copy has a previous
   factor as long as the span.
3. Where an anchor has several different spans, the first document's copies of each meet in a
   shard, which builds the suffix order of their starts, its LCP array and the longest
   previous factors. An anchor with many spans is dealt to chunks of about ``CHUNK``; what has
   no earlier match in its chunk goes to a second round, dealt by the string itself, with
   one row a chunk at most.
4. Covered intervals are merged by document. Documents without any never leave their split.

* Texts are UTF-8 bytes, null is empty; matches never cross documents; texts shorter than
  ``LEAST`` keep all. Strings are judged on the input, so overlaps count.
* Rows that share a doc_id are one document: they never cover each other. A row with a
  null doc_id keeps all and covers nothing. An empty table gives no row.
* Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import IdFilter, bounded_batches, concat_ranges, discard, forget, lean, mix, slices, staged, text_bytes

LEAST, GRAM = 50, 20
#: Most starts of one span, and about how many spans of one anchor meet in a task.
SPAN, CHUNK = 256, 4096
#: Bits of the anchor filter, of fixed size whatever the corpus.
FILTER_BITS = 1 << 27
#: Bytes of text that a bucket of anchors stands for.
BUCKET_BYTES = 16 << 20
#: Starts whose suffix order a task builds at once, at the least.
BATCH_STARTS = 200_000
#: Bytes of text whose anchors are worked out at once.
SLICE = 512 << 10


class Anchors:
    def __init__(self, least: int = LEAST, gram: int = GRAM):
        self.least, self.gram = least, min(gram, least)
        self.offsets = sorted({*range(0, max(self.gram - 7, 1), 8), max(self.gram - 8, 0)})
        self.factors = np.random.default_rng(53).integers(1, 1 << 63, len(self.offsets), np.uint64) | np.uint64(1)

    def grams(self, raw: np.ndarray) -> np.ndarray:
        """A hash of the ``gram`` bytes from each place on. It only says which strings meet."""
        n = len(raw) - self.gram + 1
        padded = np.concatenate((raw, np.zeros(8, np.uint8)))
        words = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))  # the 8 bytes from each place on
        own = np.uint64((1 << 8 * min(self.gram, 8)) - 1)
        h = np.zeros(n, np.uint64)
        for o, f in zip(self.offsets, self.factors):
            h += (words[o : o + n] & own) * f
        return mix(h)

    def spans(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(anchor, row, first start in the row, number of starts, first start in raw)."""
        none = np.zeros(0, np.int64)
        long = end - start >= self.least
        if not long.any():
            return none.astype(np.uint64), none, none, none, none
        width, size, low = self.least - self.gram + 1, 1, self.grams(raw)
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if width > size:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        starts = concat_ranges(start[long], end[long] - start[long] - self.least + 1)
        v = low[starts]
        cut = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (starts[1:] != starts[:-1] + 1))))
        length = np.diff(np.append(cut, len(v)))
        parts = -(-length // SPAN)
        first = np.repeat(cut, parts) + SPAN * concat_ranges(np.zeros(len(cut), np.int64), parts)
        count = np.minimum(SPAN, np.repeat(cut + length, parts) - first)
        at = starts[first]
        row = np.searchsorted(end, at, "right")
        return mix(v[first]), row, at - start[row], count, at


def _anchor_filter(docs: DataFrame, least: int, gram: int):
    """A broadcast bit set of the anchors in two documents or more, and its number of buckets."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(8, math.ceil(math.log2(max(1, total / BUCKET_BYTES)))))
    buckets, own = 1 << bits, FILTER_BITS >> bits

    def collect(batches):
        made = Anchors(least, gram)
        for batch in batches:
            for part in slices(batch, SLICE):
                raw, start, end = text_bytes(part.column(1))
                v, row, *_ = made.spans(raw, start, end)
                if not len(v):
                    continue
                order = np.argsort(v, kind="stable")
                v, row = v[order], row[order]
                cut = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
                twice = np.minimum.reduceat(row, cut) != np.maximum.reduceat(row, cut)
                v = np.repeat(v[cut], np.where(twice, 2, 1))
                bucket = (v >> np.uint64(64 - bits)).astype(np.int64)
                key = (v >> np.uint64(32 - bits)).astype(np.uint32)
                edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                stop = np.append(edge[1:], len(v))
                yield pa.RecordBatch.from_pydict({"bucket": bucket[edge].astype(np.int32), "keys": pa.array([key[a:b].tobytes() for a, b in zip(edge, stop)], pa.binary())})

    def repeated(batches):
        def out(bucket, keys):
            x = np.sort(np.concatenate(keys))
            x = x[1:][x[1:] == x[:-1]].astype(np.int64) % own
            flags = np.zeros(max(own // 8, 1), np.uint8)
            np.bitwise_or.at(flags, x >> 3, (1 << (x & 7)).astype(np.uint8))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "flags": pa.array([flags.tobytes()], pa.binary())})

        bucket, keys = None, []
        for batch in batches:
            for b, k in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != bucket and keys:
                    yield out(bucket, keys)
                    keys = []
                bucket = b
                keys.append(np.frombuffer(k.as_buffer(), np.uint32))
        if keys:
            yield out(bucket, keys)

    keyed = docs.mapInArrow(lean(collect), "bucket int, keys binary").repartition("bucket").sortWithinPartitions("bucket")
    table = np.zeros((buckets, max(own // 8, 1)), np.uint8)
    for r in keyed.mapInArrow(lean(repeated), "bucket int, flags binary").toLocalIterator():  # FILTER_BITS in all
        table[r["bucket"]] = np.frombuffer(r["flags"], np.uint8)
    return docs.sparkSession.sparkContext.broadcast(table), bits, own


def _shared_spans(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(v, s1, s2, doc, t, lo, n) of the spans whose anchor may occur in another document."""
    sent, bits, own = _anchor_filter(docs, least, gram)

    def run(batches):
        made = Anchors(least, gram)
        for batch in batches:
            for part in slices(batch, SLICE):
                raw, start, end = text_bytes(part.column(1))
                v, row, lo, n, at = made.spans(raw, start, end)
                key = (v >> np.uint64(32 - bits)).astype(np.uint32).astype(np.int64) % own
                hit = np.flatnonzero(sent.value[(v >> np.uint64(64 - bits)).astype(np.int64), key >> 3] >> (key & 7).astype(np.uint8) & 1)
                whole, at, size = raw.tobytes(), at[hit], n[hit] + (least - 1)
                names = np.frombuffer(b"".join([hashlib.blake2b(whole[a : a + k], digest_size=12).digest() for a, k in zip(at.tolist(), size.tolist())]), [("s1", "<i8"), ("s2", "<i4")])
                doc, t = np.asarray(part.column(0)).astype(np.int64), np.asarray(part.column(2)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "v": v[hit].astype(np.int64), "s1": names["s1"].copy(), "s2": names["s2"].copy(), "doc": doc[row[hit]], "t": t[row[hit]],
                    "lo": lo[hit].astype(np.int32), "n": n[hit].astype(np.int32),
                })

    return docs.mapInArrow(lean(run), "v long, s1 long, s2 int, doc long, t long, lo int, n int")


def previous_smaller(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each place the last one before it, from ``first`` on, whose value is smaller; -1 if there is none.

    Blocks of 2**k values, largest first, are skipped as long as none of theirs is smaller.
    """
    n = len(value)
    lowest, longest = [value], int((np.arange(n) - first).max(initial=0))
    while 2 << (len(lowest) - 1) <= longest:
        half, x = 1 << (len(lowest) - 1), lowest[-1]
        lowest.append(np.minimum(x[:-half], x[half:]))
    p = np.arange(n)
    for k in reversed(range(len(lowest))):
        start = p - (1 << k)
        can = np.flatnonzero(start >= first)
        skip = can[lowest[k][start[can]] >= value[can]]
        p[skip] = start[skip]
    return np.where(p > first, p - 1, -1)


def previous_factors(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factors, cut off at ``least`` (0: shorter), in suffix order.

    doc: of each suffix its document; lcp: with the suffix before it, cut off at ``least``.
    """
    out = np.zeros(len(doc), np.int64)
    joined = lcp >= least
    inside = np.flatnonzero(joined | np.append(joined[1:], False))  # no other suffix can have one
    if not len(inside):
        return out
    head = ~joined[inside]
    first = np.maximum.accumulate(np.where(head, np.arange(len(inside)), 0))
    tail = np.append(head[1:], True)
    last = len(inside) - 1 - np.minimum.accumulate(np.where(tail, np.arange(len(inside)), len(inside))[::-1])
    value = np.unique(doc[inside], return_inverse=True)[1].astype(np.int32)
    found = (previous_smaller(value, first) >= 0) | (previous_smaller(value[::-1], last) >= 0)[::-1]
    out[inside[found]] = least
    return out


def earlier_matches(data: list[bytes], doc: np.ndarray, count: np.ndarray, least: int):
    """(span, offset, flag) of every start of every span: does its previous factor reach ``least``?"""
    raw = np.frombuffer(b"".join(data) + bytes(64), np.uint8)
    size = np.array([len(x) for x in data], np.int64)
    first = np.cumsum(size) - size
    span = np.repeat(np.arange(len(data)), count)
    offset = concat_ranges(np.zeros(len(data), np.int64), count)
    at = first[span] + offset
    whole = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))
    words = []  # the first ``least`` bytes of each suffix as big-endian numbers, so that they sort as bytes
    for k in range(0, least, 8):
        w = whole[at + k].astype(np.uint64)
        words.append(w if least - k >= 8 else w >> np.uint64(8 * (8 - (least - k))))
    order = np.lexsort(words[::-1])
    lcp, open_ = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for k, w in enumerate(words):
        wide = min(8, least - 8 * k)
        diff = w[order[open_]] ^ w[order[open_ - 1]]
        bits = np.frexp((diff & ~(diff >> np.uint64(1))).astype(np.float64))[1]  # of the highest bit that differs; rounding cannot carry
        lcp[open_] += wide - (bits + 7) // 8
        open_ = open_[diff == 0]
    flag = np.zeros(len(order), bool)
    flag[order] = previous_factors(doc[span[order]], lcp, least) >= least
    return span, offset, flag


def _factors(rows: DataFrame, least: int) -> DataFrame:
    """Runs of starts with an earlier match as (doc, t, lo, hi); others of open rows as strings.

    rows: route, open, doc, t, lo, n, bytes. Rows of a route meet in one task.
    """

    def run(batches):
        def out(group):
            doc, count = np.array(group["doc"], np.int64), np.array(group["n"], np.int64)
            span, offset, flag = earlier_matches(group["bytes"], doc, count, least)
            edge = np.flatnonzero(flag & np.concatenate(([True], ~flag[:-1] | (span[1:] != span[:-1]))))
            stop = np.flatnonzero(flag & np.concatenate((~flag[1:] | (span[1:] != span[:-1]), [True]))) if len(flag) else edge
            who, lo, hi = span[edge], offset[edge], offset[stop] + least
            t, base = np.array(group["t"], np.int64), np.array(group["lo"], np.int64)
            left = np.flatnonzero(~flag & np.array(group["open"], bool)[span])
            text = [None] * len(who) + [group["bytes"][s][o : o + least] for s, o in zip(span[left].tolist(), offset[left].tolist())]
            who, lo, hi = np.concatenate((who, span[left])), np.concatenate((lo, offset[left])), np.concatenate((hi, offset[left] + least))
            return pa.RecordBatch.from_pydict({"doc": doc[who], "t": t[who], "lo": (base[who] + lo).astype(np.int32), "hi": (base[who] + hi).astype(np.int32), "string": pa.array(text, pa.binary())})

        names = ("route", "open", "doc", "t", "lo", "n", "bytes")
        group, starts, last = {c: [] for c in names}, 0, None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(len(names))]
            for row in zip(*cols):
                if row[0] != last and starts >= BATCH_STARTS:
                    yield out(group)
                    group, starts = {c: [] for c in names}, 0
                last = row[0]
                starts += row[5]
                for c, x in zip(names, row):
                    group[c].append(x)
        if starts:
            yield out(group)

    dealt = rows.select("route", "open", "doc", "t", "lo", "n", "bytes").repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(lean(run), "doc long, t long, lo int, hi int, string binary")


def _with_bytes(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """Adds its bytes to each wanted span (route, open, doc, t, lo, n); each text is read once."""
    by_doc = wanted.groupBy("doc", "t").agg(F.collect_list(F.struct("route", "open", "lo", "n")).alias("spans"))
    ids = by_doc.select("doc").distinct()
    texts = IdFilter(ids).maybe(docs, "doc", True).join(by_doc, ["doc", "t"]).select("doc", "t", "text", "spans")  # texts are shuffled once

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw, spans = batch.column(2)[i].as_buffer().to_pybytes(), batch.column(3)[i].values
                lo, n = np.asarray(spans.field(2)), np.asarray(spans.field(3))
                for k in range(0, len(lo), 4096):
                    part = slice(k, k + 4096)
                    m = len(lo[part])
                    pieces = pa.array([raw[x : x + y + least - 1] for x, y in zip(lo[part].tolist(), n[part].tolist())], pa.binary())
                    yield pa.RecordBatch.from_pydict({
                        "route": spans.field(0).slice(k, m), "open": spans.field(1).slice(k, m), "doc": pa.array(np.full(m, batch.column(0)[i].as_py())), "t": pa.array(np.full(m, batch.column(1)[i].as_py())),
                        "lo": spans.field(2).slice(k, m), "n": spans.field(3).slice(k, m), "bytes": pieces,
                    })

    return texts.mapInArrow(lean(cut), "route long, open boolean, doc long, t long, lo int, n int, bytes binary")


def removed_intervals(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc, t, lo, hi): intervals of bytes that go; they may overlap. docs: doc, text, t."""
    spans = staged(_shared_spans(docs, least, gram), "spans")
    forget(spans.sparkSession)
    firsts = staged(spans.groupBy("s1", "s2").agg(F.min("doc").alias("m"), F.count("*").alias("copies"), F.min("v").alias("v")), "firsts")  # a span's bytes settle its anchor
    forget(spans.sparkSession)
    anchors = firsts.groupBy("v").agg(F.count("*").alias("spans"), F.sum("copies").alias("copies")).where("spans > 1 or copies > 1").drop("copies")
    # A span that is alone with its anchor was let through by the filter for nothing.
    known = staged(firsts.drop("copies").join(anchors, "v"), "known")
    discard(firsts)
    judged = spans.drop("v").join(known, ["s1", "s2"]).where("doc > m or spans > 1").withColumn("later", F.col("doc") > F.col("m"))
    anchor = [F.when(~F.col("later"), F.col(c)).alias(c) for c in ("v", "spans")]  # of later copies nothing asks for it
    judged = staged(judged.select(*anchor, "doc", "t", "lo", "n", "later"), "judged")
    discard(spans, known)
    later = judged.where("later").select("doc", "t", "lo", (F.col("lo") + F.col("n") + (least - 1)).cast("int").alias("hi"))
    chunks = F.ceil(F.col("spans") / CHUNK)
    several = judged.where("not later").select(F.xxhash64("v", F.pmod(F.xxhash64("doc", "v"), chunks)).alias("route"), (chunks > 1).alias("open"), "doc", "t", "lo", "n")
    found = staged(_factors(_with_bytes(docs, several, least), least), "factors")
    forget(spans.sparkSession)
    again = found.where("string is not null").select(F.xxhash64("string").alias("route"), F.lit(False).alias("open"), "doc", "t", "lo", F.lit(1).alias("n"), F.col("string").alias("bytes"))
    inner = found.where("string is null").union(_factors(again, least))
    out = staged(later.union(inner.select("doc", "t", "lo", "hi")), "intervals")
    discard(judged, found)
    return out


def remove_repeats(docs: DataFrame, *, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Of each row doc_id, n_bytes, removed (merged intervals of bytes) and kept (bytes)."""
    bounded_batches(docs.sparkSession)
    all_rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64("text").alias("t"))
    named = all_rows.where("doc is not null")
    intervals = removed_intervals(named, least, gram)
    merged = intervals.groupBy("doc", "t").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("cut"))
    affected = IdFilter(intervals.select("doc").distinct())

    def cut(batches):
        for batch in batches:
            kept, runs_of, size = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs: list[list[int]] = []
                if spans.is_valid:
                    lo, hi = (np.asarray(spans.values.field(k)) for k in (0, 1))
                    top = np.maximum.accumulate(hi)
                    new = np.concatenate(([True], lo[1:] > top[:-1]))
                    runs = [list(x) for x in zip(lo[new].tolist(), np.maximum.reduceat(hi, np.flatnonzero(new)).tolist())]
                parts, at = [], 0
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join(parts) + raw[at:])
                runs_of.append(runs)
                size.append(len(raw))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(size, pa.int64()), "removed": pa.array(runs_of, pa.list_(pa.list_(pa.int32()))), "kept": pa.array(kept, pa.binary())})

    schema = "doc_id long, n_bytes long, removed array<array<int>>, kept binary"
    touched = affected.maybe(all_rows, "doc", True).join(merged, ["doc", "t"], "left").select("doc", "text", "cut")
    whole = affected.maybe(all_rows, "doc", False)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    untouched = whole.select(F.col("doc").alias("doc_id"), F.length(raw).cast("long").alias("n_bytes"), F.array().cast("array<array<int>>").alias("removed"), raw.alias("kept"))
    return touched.mapInArrow(lean(cut), schema).union(untouched)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], least: int = LEAST) -> list[tuple]:
    """The same digest from a table of all strings of ``least`` bytes; for small inputs."""
    seen: dict[bytes, int] = {}
    for i, text in docs:
        raw = (text or "").encode()
        for p in range(len(raw) - least + 1):
            s = raw[p : p + least]
            seen[s] = min(i, seen.get(s, i))
    out = []
    for i, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            if seen[raw[p : p + least]] < i:
                gone[p : p + least] = b"\1" * least
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), sum(1 for p in range(len(raw)) if gone[p] and (not p or not gone[p - 1])), hashlib.sha256(kept).hexdigest()))
    return out
