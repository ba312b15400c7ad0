"""Packing by lexical retrieval: documents that share rare tokens fill one window.

Documents are tokenised once and dealt by content: in order of their two most frequent token
ids, which tell languages and manners of writing apart, into ranges of about
``SHARD_TOKENS`` ids; a content that many documents share is split over as many ranges as it
takes. Each task builds a BM25 inverted index over a shard of its range and fills windows: a
seed document, then its nearest unused neighbours in order of BM25 score, then (none left)
unused documents in reading order. A document that does not fit is cut, and its rest seeds
the next window. The shard's last, partly filled window is cut into sequences whose lengths
are powers of two.

* A document is its token ids and then one end id, so a null or empty text is that id alone.
* Every id lies in exactly one piece; nothing is dropped, whatever a text's length.
* Ties in score go to the document read first. Repeated rows are documents of their own.
* An empty table gives no piece. Columns other than the named ones are ignored.
* A document's neighbours come from its shard only: memory is bounded by ``SHARD_TOKENS``
  (a longer document is a shard of its own), and alike documents in other shards do not meet.

``sequence_id`` is (partition << 32) + number.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import bounded_batches, concat_ranges, lean, mix, staged
from cohorta.llm.tokens import TextIds, read_tokenizer, text_ids

WINDOW, END_ID = 4096, 2
#: Most token ids of one shard; a longer document is a shard of its own.
SHARD_TOKENS = 3_000_000
#: A term in more than one of so many documents of a shard is held as a dense row of weights.
COMMON = 8
#: Neighbours put in order at once; few windows need more.
FIRST = 64
K1, B = 1.2, 0.75


class Index:
    """BM25 postings of one shard: of each term the documents and their weights."""

    def __init__(self, ids: list[np.ndarray]):
        self.n = len(ids)
        terms, counts, sizes = [], [], []
        for x in ids:
            x = np.sort(x, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            terms.append(x[cut])
            counts.append(np.diff(np.append(cut, len(x))))
            sizes.append(len(cut))
        term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        doc = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        length = np.array([len(x) for x in ids], np.float32)
        df = np.bincount(term, minlength=int(term.max()) + 1)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / length.mean())[doc]))
        self.term = term
        order = np.argsort(term, kind="stable")
        self.doc, self.by_term = doc[order], weight[order]
        self.start = np.concatenate(([0], np.cumsum(df)))
        self.df = df
        common = np.flatnonzero(df * COMMON > self.n)
        self.row = np.full(len(df), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        place = concat_ranges(self.start[common], df[common])
        self.dense[np.repeat(np.arange(len(common)), df[common]), self.doc[place]] = self.by_term[place]

    def near(self, seed: int, used: np.ndarray) -> np.ndarray:
        """The unused documents that share a term with the seed, best first; every term of the seed counts."""
        return np.concatenate(list(self.runs(seed, used)))

    def runs(self, seed: int, used: np.ndarray) -> Iterator[np.ndarray]:
        """What ``near`` gives: the best ``FIRST`` and their ties, then, only when asked for, all others."""
        term = self.term[self.at[seed] : self.at[seed + 1]]
        term = term[self.df[term] > 1]
        rare = term[self.row[term] < 0]
        place = concat_ranges(self.start[rare], self.df[rare])
        score = np.bincount(self.doc[place], self.by_term[place], self.n)
        score = score + self.dense[self.row[term[self.row[term] >= 0]]].sum(axis=0)
        score[used] = 0
        found = np.flatnonzero(score)
        rank = -score[found]
        best = rank <= np.partition(rank, FIRST - 1)[FIRST - 1] if len(found) > FIRST else np.ones(len(found), bool)
        yield found[best][np.argsort(rank[best], kind="stable")]
        yield found[~best][np.argsort(rank[~best], kind="stable")]


def pack_shard(ids: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover all ids of a shard."""
    index = Index(ids)
    length = [len(x) for x in ids]
    used = np.zeros(len(ids), bool)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, room, following, first, carry = 0, window, 0, 0, None

    def place(doc: int, start: int) -> int:
        """Puts what fits of a document into the open window; gives the place of the rest."""
        nonlocal room, sequence, first
        n = min(room, length[doc] - start)
        out.append((doc, start, n, sequence, window - room))
        room -= n
        if not room:
            sequence, room, first = sequence + 1, window, len(out)
        return start + n

    while True:
        if carry is None:
            while following < len(ids) and used[following]:
                following += 1
            if following == len(ids):
                break
            seed, at = following, 0
            used[seed] = True
        else:
            (seed, at), carry = carry, None
        opened = sequence
        at = place(seed, at)
        if at < length[seed]:
            carry = (seed, at)
            continue
        if sequence > opened:
            continue
        for other in itertools.chain.from_iterable(map(np.ndarray.tolist, index.runs(seed, used))):
            used[other] = True
            at = place(other, 0)
            if at < length[other]:
                carry = (other, at)
            if sequence > opened:
                break
    tail, out = out[first:], out[:first]
    left = window - room
    for k in reversed(range(left.bit_length())):
        if not left >> k & 1:
            continue
        offset, size = 0, 1 << k
        while offset < size:
            doc, start, n, _, _ = tail[0]
            m = min(n, size - offset)
            out.append((doc, start, m, sequence, offset))
            tail[:1] = [(doc, start + m, n - m, 0, 0)] if n > m else []
            offset += m
        sequence += 1
    return out


def content_key(ids: np.ndarray) -> int:
    """The two most frequent ids, the most frequent first (ties: the smaller id); -1 stands for none."""
    if not len(ids):
        return 0
    x = np.sort(ids, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    n = np.diff(cut, append=len(x))
    first = n.argmax()
    key = int(x[cut[first]]) + 1 << 32
    n[first] = 0
    second = n.argmax()
    return key + int(x[cut[second]]) + 1 if n[second] else key


def _tokenised(docs: DataFrame, spec) -> DataFrame:
    """(doc_id, n, key, place, ids): each document's ids, compressed, its content, and a number of its own."""

    def run(batches):
        encode, press, row = text_ids(spec.value), zstandard.ZstdCompressor(level=1).compress, 0
        for batch in batches:
            raw = [encode(t.as_py()) for t in batch.column(1)]
            ids = [np.frombuffer(x, encode.dtype) for x in raw]
            place = mix(np.arange(row, row + len(ids), dtype=np.uint64) + (np.uint64(TaskContext.get().partitionId()) << np.uint64(40)))
            row += len(ids)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n": pa.array([len(x) for x in ids], pa.int64()), "key": pa.array([content_key(x) for x in ids], pa.int64()),
                "place": place.astype(np.int64), "ids": pa.array([press(x) for x in raw], pa.binary()),
            })

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    return plain.mapInArrow(lean(run), "doc_id long, n long, key long, place long, ids binary")


def pack(docs: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32 bits)."""
    bounded_batches(docs.sparkSession)
    text = read_tokenizer(tokenizer)
    spec, wide = docs.sparkSession.sparkContext.broadcast(text), TextIds(text).dtype.str

    def run(batches):
        unpress, dtype = zstandard.ZstdDecompressor().decompress, np.dtype(wide)
        end = np.array([end_id], dtype).tobytes()
        base = TaskContext.get().partitionId() << 32
        sequences = 0

        def flush(shard):
            nonlocal sequences
            ids = [x for _, x in shard]
            pieces = pack_shard(ids, window)
            for low in range(0, len(pieces), 1024):
                d, s, n, q, o = (np.array(x, np.int64) for x in zip(*pieces[low : low + 1024]))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([shard[i][0] for i in d.tolist()], pa.int64()), "start": s, "length": n,
                    "doc_tokens": np.array([len(ids[i]) for i in d.tolist()], np.int64), "sequence_id": q + sequences + base, "offset": o,
                    "ids": pa.array([ids[i][a : a + m].astype("<u4").tobytes() for i, a, m in zip(d.tolist(), s.tolist(), n.tolist())], pa.binary()),
                })
            sequences += pieces[-1][3] + 1

        shard, size = [], 0
        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(unpress(packed) + end, dtype)
                if shard and size + len(x) > shard_tokens:
                    yield from flush(shard)
                    shard, size = [], 0
                shard.append((doc_id, x))
                size += len(x)
        if shard:
            yield from flush(shard)

    made = staged(_tokenised(docs, spec), "tokens")
    total = made.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    dealt = made.repartitionByRange(max(1, -(-total // shard_tokens)), "key", "place").sortWithinPartitions("key", "place").select("doc_id", "ids")
    return dealt.mapInArrow(lean(run), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
