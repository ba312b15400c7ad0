"""What the training-data operators share: staging, byte-level words, fold hashes."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_A_TO_Z = bytes(range(65, 91))
LOWER = bytes(b + 32 if b in _A_TO_Z else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own; a cluster without
    one is an error, since no folder of one machine would do.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="cohorta-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes of a Parquet row group of intermediate tables: what a writing task holds in memory.
GROUP_BYTES = 16 << 20


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation of ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect its garbage.

    Shuffle files go when it has collected what refers to them, so without this those of jobs that
    have ended pile up beside the next steps'. The last query's stay referred to until another has ended.
    """
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def discard(*written: DataFrame) -> None:
    """Deletes the folders of staged frames that no frame still to be run reads, and shuffle files of the jobs that wrote them."""
    if written:
        forget(written[0].sparkSession)
    for df in written:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, most_bytes: int = 4 << 20) -> None:
    """Rows reach Python in batches of at most ``rows`` rows and about ``most_bytes`` bytes.

    So a task's memory stays small whatever its texts (one text at least is a batch). These are
    settings of the session and hold when a frame is run, so they stay after the operator
    has returned; smaller ones that the caller has set are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes), ("spark.sql.parquet.columnarReaderBatchSize", rows)):
        digits = re.sub(r"\D", "", spark.conf.get(key))
        if not digits or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


@functools.cache
def _trim():
    """glibc's malloc_trim, or nothing on systems without it."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def lean(run):
    """A ``mapInArrow`` function whose worker gives its free memory back when a task ends.

    Spark keeps Python workers for later tasks and stages; without this each of them holds
    the most that any of its tasks ever needed.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return wrapped


_KEPT: dict = {}


def kept(key: tuple, make):
    """What outlives a task in a Python worker: the object asked for last, and no other."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``n``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, each row's start and end; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start, end = at[:-1] - at[0], at[1:] - at[0]
    if column.null_count:
        end = np.where(np.asarray(column.is_valid()), end, start)
    return raw[at[0] : at[-1]], start, end


def slices(batch: pa.RecordBatch, most_bytes: int = 2 << 20, column: str = "text"):
    """Cut a batch into runs of rows of about ``most_bytes`` of text, one row at least."""
    if not batch.num_rows:
        return
    _, start, end = text_bytes(batch.column(column))
    run, size = 0, np.cumsum(end - start)
    while run < batch.num_rows:
        before = size[run - 1] if run else 0
        to = max(run + 1, int(np.searchsorted(size, before + most_bytes, "right")))
        yield batch.slice(run, to - run)
        run = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def digest(data: bytes) -> int:
    """A signed 64-bit number from a cryptographic hash of the bytes."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class WordNumbers(dict):
    """64-bit numbers of words, each from a cryptographic hash of its bytes, worked out once."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        n = self[word] = digest(word)
        return n


def arrow_rows(batches, work, out_schema: pa.Schema, most_bytes: int = 2 << 20, column: str = "text"):
    """Run ``work(batch) -> list of arrays`` on bounded slices of the input batches."""
    for batch in batches:
        for part in slices(batch, most_bytes, column):
            yield pa.RecordBatch.from_arrays(work(part), schema=out_schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def concat_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...`` for ``length[i]`` values, one run after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total) - np.repeat(first - start, length)


def quiet_threads() -> None:
    """One task has one core: native libraries start no threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


class IdFilter:
    """A bit set of fixed size that has every given id's hash; a few others may be in it too.

    Sent to the executors, it spares rows that a join would drop their shuffle. Its size does
    not grow with the ids: beyond its capacity it only spares less.
    """

    BITS = 1 << 25

    def __init__(self, ids: DataFrame):
        def fill(batches):
            bits = np.zeros(IdFilter.BITS // 8, np.uint8)
            for batch in batches:
                h = np.asarray(batch.column(0)).astype(np.int64) & (IdFilter.BITS - 1)
                np.bitwise_or.at(bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
            words = bits.view(np.int64)
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "word": words[at]})

        words = ids.select(F.xxhash64(F.col(ids.columns[0]).cast("long")).alias("h")).mapInArrow(fill, "at int, word long")
        table = np.zeros(IdFilter.BITS // 64, np.int64)
        found = words.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # BITS / 64 rows at most
        table[np.asarray(found.column("at"))] = np.asarray(found.column("word"))
        self.sent = ids.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def maybe(self, rows: DataFrame, key: str, inside: bool) -> DataFrame:
        """The rows whose ``key`` (a long) may be in the set, or those whose key is not."""
        sent, name = self.sent, free_name(rows, "h")

        def keep(batches):
            for batch in batches:
                last = batch.num_columns - 1
                h = np.asarray(batch.column(last)).astype(np.int64) & (IdFilter.BITS - 1)
                hit = (sent.value[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
                found = np.flatnonzero(hit if inside else ~hit)
                if len(found):
                    yield batch.select(list(range(last))).take(pa.array(found))

        return rows.withColumn(name, F.xxhash64(key)).mapInArrow(keep, rows.schema)

    def semi_join(self, rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
        """The rows whose ``key`` is in ``ids`` (a column of that name); key must be a long."""
        return self.maybe(rows.where(F.col(key).isNotNull()), key, True).join(ids, key, "left_semi")
