"""MinHash near-deduplication with sequential Bayesian verification.

1. Every text becomes the set of its distinct 5-word shingles (64-bit hashes), a MinHash
   signature and a 128-bit key of the set. Equal sets collapse to one class (map-side).
2. Bands of the signature bring classes together; buckets of one class are dropped.
3. In a bucket, signatures are compared a batch at a time; a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold, under a uniform prior,
   is below ``MISS``. Buckets are cut into blocks of about ``BLOCK`` classes and
   ``BLOCK_BYTES`` of sets, so no task holds an unbounded bucket.
4. Three rounds verify survivors, and each emits a forest of a block at most, so copies are
   never expanded into all pairs: within each block; between one class of each component
   of a bucket of several blocks; and, for buckets whose classes are still apart, between
   all blocks, where full sets travel along and every survivor whose ends are apart is
   verified on the spot.
5. Links of any round are confirmed on the words of both texts themselves, no hashes.
6. Components of the confirmed links by star contraction.

* Words: ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Fewer than five words: the whole
  sequence is one shingle. Null, empty and blank texts have none and are linked with nothing.
* A link: 100 * intersection >= 85 * union (a parameter, in hundredths).
* Rows that share a doc_id count as one document with several texts. A row whose doc_id is
  null has a null component and is kept.
* A link at the very threshold fails to share a band with a probability below ``MISS`` (at 0.85
  25 bands of five rows: 4e-7; at 0.80 30 bands: 7e-6). Each comparison of a batch prunes it with
  a probability of about ``MISS`` at most, so with 5 or 6 batches a few times ``MISS`` in all.
* One row comes back for each input row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import IdFilter, bounded_batches, discard, lean, slices, staged
from cohorta.llm.components import components
from cohorta.llm.shingles import HASHES, Shingles, exact_set, set_key, signature

HUNDREDTHS = 85
ROWS = 5
BATCH = 25
#: Most hashes of a signature.
MOST_HASHES = 750
MISS = 1e-5
#: About the most classes, and bytes of their full sets, of one block of a bucket.
BLOCK, BLOCK_BYTES = 1024, 32 << 20


def least_matches(threshold: float, n: int, miss: float) -> int:
    """The fewest matches of ``n`` at which P(similarity >= threshold) is at least ``miss``."""
    for m in range(n + 1):
        # The upper tail of Beta(m + 1, n - m + 1) as a lower tail of a binomial.
        tail = sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        if tail >= miss:
            return m
    return n


def band_hashes(hundredths: int, miss: float) -> int:
    """``HASHES``, or as many more, in whole batches, as let a pair at the threshold miss all bands below ``miss``."""
    bands = math.log(miss) / math.log(1 - (hundredths / 100) ** ROWS) if hundredths < 100 else 1
    hashes = max(HASHES, BATCH * math.ceil(ROWS * math.ceil(bands) / BATCH))
    if hashes > MOST_HASHES:
        raise ValueError(f"{hashes} hashes for {hundredths} hundredths, {MOST_HASHES} at most")
    return hashes


def _signatures(docs: DataFrame, hashes: int) -> DataFrame:
    def run(batches):
        made = Shingles()
        for batch in batches:
            for part in slices(batch, 1 << 20):
                sets = made.sets(part.column(1))
                keys = [set_key(x) if len(x) else (None, None) for x in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                    "k1": pa.array([k for k, _ in keys], pa.int64()), "k2": pa.array([k for _, k in keys], pa.int64()),
                    "sig": pa.array([signature(x, hashes).tobytes() if len(x) else None for x in sets], pa.binary()),
                })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def _bands(classes: DataFrame, hashes: int) -> DataFrame:
    """(rep, k1, n, band, bucket) for each band of each class; bucket: a hash of band and rows."""
    row = lambda j: F.substring("sig", 1 + 4 * ROWS * j, 4 * ROWS)
    keys = F.array(*[F.xxhash64(F.lit(j), row(j)) for j in range(hashes // ROWS)])
    return classes.select("rep", "k1", "n", F.posexplode(keys).alias("band", "bucket"))


def _dealt(members: DataFrame, salt: int) -> DataFrame:
    """The rows of buckets with two members or more, each with its bucket's blocks and its own.

    members: bucket, rep, n and others.
    """
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(8 * F.col("n")) / BLOCK_BYTES)).cast("int")
    many = members.groupBy("bucket").agg(F.count("*").alias("size"), size.alias("blocks")).where("size > 1").drop("size")
    return members.join(many, "bucket").withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "rep", "bucket"), F.col("blocks")).cast("int"))


def _own_block(members: DataFrame) -> DataFrame:
    return members.withColumn("low", F.col("block")).withColumn("high", F.col("block"))


def _all_blocks(members: DataFrame) -> DataFrame:
    """Sends each member to every pair of blocks that has its block; one for most buckets."""
    both = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def _forest(members: DataFrame, hundredths: int, miss: float, hashes: int) -> DataFrame:
    """Pairs (a, b) of classes: a spanning forest of the surviving pairs of each pair of blocks.

    members: bucket, band, rep, n, sig, component, low, high, block. Where they bring their
    full sets (column shingles), the forest is one of links verified on these.
    """
    threshold, full = hundredths / 100, "shingles" in members.columns
    steps = [(k, least_matches(threshold, k, miss)) for k in range(BATCH, hashes + 1, BATCH)]
    carried = ["rep", "n", "sig", "component", "block", *(["shingles"] if full else [])]

    def compare(left, right, same, band):
        """Places in both lists, and matches, of the surviving pairs of two lists of members."""
        ls, rs, ln, rn, lc, rc = left["sig"], right["sig"], left["n"], right["n"], left["component"], right["component"]
        for at in range(0, len(ls), 256):
            ok = (100 * np.minimum(ln[at : at + 256, None], rn) >= hundredths * np.maximum(ln[at : at + 256, None], rn)) & (lc[at : at + 256, None] != rc)
            if same:
                ok &= np.arange(at, min(at + 256, len(ls)))[:, None] < np.arange(len(rs))
            i, j = np.nonzero(ok)
            i += at
            m = np.zeros(len(i), np.int32)
            for k, least in steps:
                for low in range(0, len(i), 1 << 16):
                    m[low : low + (1 << 16)] += (ls[i[low : low + (1 << 16)], k - BATCH : k] == rs[j[low : low + (1 << 16)], k - BATCH : k]).sum(axis=1, dtype=np.int32)
                keep = m >= least
                i, j, m = i[keep], j[keep], m[keep]
            # A pair belongs to the first band that both are in, and so comes up once.
            if len(i):
                mine = (ls[i] == rs[j]).reshape(len(i), -1, ROWS).all(axis=2).argmax(axis=1) == band
                yield i[mine].astype(np.int32), j[mine].astype(np.int32), m[mine]

    def linked(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= hundredths * (len(x) + len(y) - common)

    def run(batches):
        def flush(group):
            if len(group["rep"]) < 2:
                return None
            g = {"sig": np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, hashes), **{c: np.array(group[c], np.int64) for c in ("rep", "n", "component", "block")}}
            low, high, band = group["low"], group["high"], group["band"]
            at_low, at_high = np.flatnonzero(g["block"] == low), np.flatnonzero(g["block"] == high)
            left, right = ({c: v[at] for c, v in g.items()} for at in (at_low, at_high))
            found = list(compare(left, right, low == high, band))
            if not found:
                return None
            i, j, m = (np.concatenate([f[k] for f in found]) for k in range(3))
            parent: dict[int, int] = {}

            def root(x):
                while (y := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(y, y)
                return x

            a, b = [], []
            for t in np.argsort(-m, kind="stable").tolist():
                x, y = root(int(left["component"][i[t]])), root(int(right["component"][j[t]]))
                if x != y and (not full or linked(group["shingles"][at_low[i[t]]], group["shingles"][at_high[j[t]]])):
                    parent[x] = y
                    a.append(left["rep"][i[t]])
                    b.append(right["rep"][j[t]])
            return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)}) if a else None

        key, group = None, None
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                here = (cols["bucket"][i], cols["band"][i], cols["low"][i], cols["high"][i])
                if here != key:
                    if group and (out := flush(group)):
                        yield out
                    key, group = here, {"band": here[1], "low": here[2], "high": here[3], **{c: [] for c in carried}}
                for c in carried:
                    group[c].append(cols[c][i])
        if group and (out := flush(group)):
            yield out

    dealt = members.select("bucket", "band", "low", "high", *carried).repartition("bucket", "low", "high").sortWithinPartitions("bucket", "band", "low", "high", "rep")
    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents named in ids."""
    return IdFilter(ids).semi_join(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, "id")


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, k1, shingles): the whole sets, as bytes, of the documents named in ids."""

    def run(batches):
        made = Shingles()
        for batch in batches:
            for part in slices(batch, 1 << 20):
                sets = made.sets(part.column(1))
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "k1": pa.array([set_key(x)[0] for x in sets], pa.int64()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})

    return _texts_of(docs, ids).mapInArrow(lean(run), "id long, k1 long, shingles binary")


def _confirmed(docs: DataFrame, pairs: DataFrame, hundredths: int) -> DataFrame:
    """Of the pairs those whose texts are linked, by the words themselves."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = staged(_texts_of(docs, ids), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = exact_set(x.as_py()), exact_set(y.as_py())
                common = len(x & y)
                keep.append(common > 0 and 100 * common >= hundredths * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = staged(both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long").distinct(), "links")
    discard(texts)
    return out


def near_duplicates(docs: DataFrame, *, hundredths: int = HUNDREDTHS, miss: float = MISS) -> DataFrame:
    """Of each input row doc_id, n_shingles, component_id (smallest doc_id reachable) and kept."""
    bounded_batches(docs.sparkSession)
    hashes = band_hashes(hundredths, miss)
    all_rows = staged(_signatures(docs, hashes), "signatures")
    named = all_rows.where("doc_id is not null and k1 is not null")
    classes = staged(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    crowded = staged(_dealt(_bands(classes, hashes), 0).join(classes.select("rep", "k1", "sig"), ["rep", "k1"]), "buckets")

    def labelled(rows: DataFrame) -> DataFrame:
        """Rows of buckets whose classes are not all in one component, with their component."""
        own = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        apart = own.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("bucket")
        return own.join(apart, "bucket", "left_semi")

    def merged(links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return found
        out = staged(components(found.select("node", "component").toDF("a", "b").union(links)), "components")
        discard(found)
        return out

    tried = staged(_forest(_own_block(crowded.withColumn("component", F.col("rep"))), hundredths, miss, hashes), "forest")
    links = _confirmed(docs, tried, hundredths)
    found = staged(components(links), "components")
    discard(tried, links)

    # One class of each component of a bucket of several blocks.
    rows = labelled(crowded.where("blocks > 1"))
    heads = rows.groupBy("bucket", "band", "component").agg(F.min(F.struct("rep", "n", "sig")).alias("head")).select("bucket", "band", "component", "head.*")
    tried = staged(_forest(_own_block(_dealt(heads, 1)), hundredths, miss, hashes), "forest")
    links = _confirmed(docs, tried, hundredths)
    found = merged(links)
    discard(tried, links)

    rows = staged(labelled(crowded), "apart")
    sets = staged(_sets_of(docs, rows.select(F.col("rep").alias("id")).distinct()), "sets")
    whole = rows.join(sets.select(F.col("id").alias("rep"), "k1", "shingles").dropDuplicates(["rep", "k1"]), ["rep", "k1"])
    tried = staged(_forest(_all_blocks(whole), hundredths, miss, hashes), "forest")
    links = _confirmed(docs, tried, hundredths)
    found = merged(links)
    discard(crowded, rows, sets, tried, links)

    of_class = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    judged = all_rows.drop("sig").join(of_class, ["k1", "k2"], "left")
    judged = judged.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return judged.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
