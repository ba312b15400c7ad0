"""Training-order materialisation: token sequences in keyed random order, in binary shards.

Each task joins the token ids of its documents, an end id after each, and cuts the stream
into sequences of ``LENGTH``; its last sequence is padded. These are written once, compressed,
and counted. A keyed Feistel permutation with cycle-walking sends a sequence's number, 0 to
N - 1, to a global slot. Shard k holds the slots from k * ``PER_SHARD`` on; slots are dealt to
tasks in ranges of whole shards, and each task sorts its slots and writes its shards one after
the other as files of fixed stride. So slot s of a shard starts at byte
(s mod PER_SHARD) * stride, and a reader can resume anywhere.

* A stride is a little-endian unsigned 32-bit count of true ids, then ``LENGTH`` ids (2 bytes
  each if the vocabulary has at most 65,536 tokens, else 4), the padding zero.
* Null and empty texts are their end id alone. An empty table writes no file, gives no row.
* Repeated rows are documents of their own; rows with a null doc_id are written too and
  listed with a null id. Columns other than doc_id and text are ignored.
* Numbers follow the parts in which the sequences were first written. ``docs`` is read once.
* A file is written under a task's own name and then moved, so a lost executor's half file is
  never taken for a shard; a repeated task writes the same bytes.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import bounded_batches, discard, lean, mix, shared_dir, staged
from cohorta.llm.tokens import read_tokenizer, text_ids

LENGTH, PER_SHARD, END_ID, KEY, ROUNDS = 2048, 4096, 2, 0x5EED, 6
#: Most tasks that write shards; with more shards each task writes several.
MOST_TASKS = 20_000


def feistel(number: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, applied to each number."""
    half = np.uint64(max(1, math.ceil(math.log2(max(n, 2)) / 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key))

    def once(x):
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << half | right

    out = once(number.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):  # walk the cycle until it is back in range
        out[far] = once(out[far])
    return out.astype(np.int64)


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _sequences(batches, spec: str, length: int, end_id: int):
    """(doc_ids, number of true ids, ids as bytes) of each sequence of a task."""
    encode = text_ids(spec)
    wide = encode.dtype.itemsize
    end = np.array([end_id], encode.dtype).tobytes()
    buffer, owners = bytearray(), []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            buffer += encode(text.as_py()) + end
            owners.append(doc_id)
            at = 0
            while len(buffer) - at >= length * wide:
                yield owners, length, bytes(buffer[at : at + length * wide])
                at += length * wide
                owners = [doc_id] if len(buffer) > at else []
            del buffer[:at]
    if buffer:
        yield owners, len(buffer) // wide, bytes(buffer) + bytes(length * wide - len(buffer))


def write_shards(docs: DataFrame, path: str, *, tokenizer: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, end_id: int = END_ID, key: int = KEY) -> DataFrame:
    """Writes the shards under ``path`` and gives a manifest: a row for each sequence.

    slot, number (before permuting), shard, byte_offset, n_tokens, crc32 of the true ids'
    bytes, and doc_ids, the documents that it has ids of.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    manifest = "slot long, number long, shard int, byte_offset long, n_tokens int, crc32 long, doc_ids array<long>"

    def cut(batches):
        part, seen, rows = TaskContext.get().partitionId(), 0, []
        press = zstandard.ZstdCompressor(level=1).compress

        def out():
            n = len(rows)
            return pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(n, part, np.int32)), "at": pa.array(np.arange(seen - n, seen)), "n_tokens": pa.array([r[1] for r in rows], pa.int32()),
                "doc_ids": pa.array([r[0] for r in rows], pa.list_(pa.int64())), "ids": pa.array([press(r[2]) for r in rows], pa.binary()),
            })

        for row in _sequences(batches, spec.value, length, end_id):
            rows.append(row)
            seen += 1
            if len(rows) == 512:
                yield out()
                rows = []
        if rows:
            yield out()

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    sequences = staged(plain.mapInArrow(lean(cut), "part int, at long, n_tokens int, doc_ids array<long>, ids binary"), "sequences")
    counts = {r["part"]: r["n"] for r in sequences.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number a part
    total = sum(counts.values())
    if not total:
        return spark.createDataFrame([], manifest)
    first, at = {}, 0
    for p in sorted(counts):
        first[p], at = at, at + counts[p]
    sent = spark.sparkContext.broadcast(first)

    def permute(batches):
        for batch in batches:
            base = np.array([sent.value[p] for p in batch.column(0).to_pylist()], np.int64)
            number = base + np.asarray(batch.column(1))
            slot = feistel(number, total, key)
            yield pa.RecordBatch.from_pydict({"slot": slot, "number": number, "shard": (slot // per_shard).astype(np.int32)} | {f.name: batch.column(k) for k, f in enumerate(batch.schema) if k > 1})

    def write(batches):
        stream = name = fs = temp = None
        shard = size = None
        unpress = zstandard.ZstdDecompressor().decompress

        def close():
            if stream is not None:
                stream.close()
                fs.move(temp, name)

        for batch in batches:
            rows = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            offsets, sums = [], []
            for s, slot, n, ids in zip(rows["shard"], rows["slot"], rows["n_tokens"], rows["ids"]):
                if s != shard:
                    close()
                    shard, size = s, 0
                    fs, folder = _filesystem(path)
                    fs.create_dir(folder, recursive=True)
                    name = f"{folder}/shard-{s:08d}.bin"
                    temp = f"{folder}/.{s:08d}-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(temp)
                ids = unpress(ids)
                stride = np.array([n], "<u4").tobytes() + ids
                offsets.append((slot % per_shard) * len(stride))
                sums.append(zlib.crc32(ids[: n * (len(ids) // length)]))
                if offsets[-1] != size:
                    raise RuntimeError(f"slot {slot} is out of place")
                stream.write(stride)
                size += len(stride)
            yield pa.RecordBatch.from_pydict({
                "slot": batch.column("slot"), "number": batch.column("number"), "shard": batch.column("shard"), "byte_offset": pa.array(offsets, pa.int64()),
                "n_tokens": batch.column("n_tokens"), "crc32": pa.array(sums, pa.int64()), "doc_ids": batch.column("doc_ids"),
            })
        close()

    rows = sequences.mapInArrow(permute, "slot long, number long, shard int, n_tokens int, doc_ids array<long>, ids binary")
    shards = -(-total // per_shard)
    each = -(-shards // min(shards, MOST_TASKS))
    dealt = rows.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
    out = staged(dealt.mapInArrow(lean(write), manifest), "manifest")
    discard(sequences)
    return out


def read_shard(path: str, shard: int, *, start: int = 0, length: int = LENGTH, dtype: str = "<u2"):
    """The sequences of a shard from its row ``start`` on, one after the other."""
    fs, folder = _filesystem(path)
    wide = np.dtype(dtype).itemsize
    stride = 4 + length * wide
    with fs.open_input_file(f"{folder}/shard-{shard:08d}.bin") as f:
        f.seek(start * stride)
        while len(raw := f.read(stride)) == stride:
            n = int(np.frombuffer(raw[:4], "<u4")[0])
            yield np.frombuffer(raw[4:], dtype)[:n]


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all sequences, each with the crc32 of what its file holds, read back."""
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)

    def check(batches):
        for batch in batches:
            shard, offset, n = (batch.column(c).to_pylist() for c in ("shard", "byte_offset", "n_tokens"))
            stride = 4 + 2 * LENGTH
            sums = [0] * batch.num_rows
            by_shard: dict[int, list[int]] = {}
            for i, s in enumerate(shard):
                by_shard.setdefault(s, []).append(i)
            fs, folder = _filesystem(path)
            for s, rows in by_shard.items():
                with fs.open_input_file(f"{folder}/shard-{s:08d}.bin") as f:
                    for i in rows:
                        f.seek(offset[i])
                        raw = f.read(stride)
                        sums[i] = zlib.crc32(raw[4 : 4 + 2 * n[i]]) if int.from_bytes(raw[:4], "little") == n[i] else -1
            kept = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            yield pa.RecordBatch.from_pydict(kept | {"file_crc32": pa.array(sums, pa.int64())})

    return manifest.mapInArrow(check, manifest.withColumn("file_crc32", F.lit(0).cast("long")).schema)
