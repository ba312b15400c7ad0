"""Exact top-k search by inner product: ball trees, branch and bound, shared bounds.

1. A ball tree of at most ``TOP_SHARDS`` leaves, fitted on a bounded sample of ``SAMPLE`` vectors,
   deals every vector to the leaf with the nearest centre; a leaf of many vectors is cut
   into shards of about ``SHARD_ROWS``. So near vectors share a shard, and a shard is a ball.
2. Each query searches its home shard first. In a shard's own ball tree nodes are opened in
   order of the bound q.c + |q| r, for the queries whose bound reaches their k-th score only.
3. Queries with their k-th scores then go in broadcast blocks of ``QUERY_BYTES`` to all
   shards. A shard whose ball cannot reach a query's k-th score is passed over; a task
   hands the k-th scores that it finds on to its next shards and sends k rows a query.

* A component x counts as floor(scale * x), x as double; scores are exact integers. Components of
  2**62 or more in size, and scores beyond 64 bits, are refused with an error, not rounded.
* Rows with a null id, a null vector, or a null or non-finite component take no part.
* Vectors of different length are never compared; an empty vector scores 0 with its like.
* Ties go to the smaller id. A query's candidates are all rows but itself: another row of
  its id is one, and each of several query rows with one id gets rows of its own.
* A query without candidates has no row; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import bounded_batches, discard, lean, staged

SHARD_ROWS, LEAF, TOP_SHARDS = 4096, 128, 1024
#: Most rows of the sample that deals vectors to shards, and bytes of queries in one broadcast.
SAMPLE, QUERY_BYTES = 20_000, 16 << 20
SCALE, K, EVERY = 256, 5, 50
_EXACT = float(1 << 53)
_LONG = 1 << 63


def _halves(points: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``own`` in an order whose first and second half lie on two sides of a ball."""
    far = points[((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    other = points[((points - far) ** 2).sum(axis=1).argmax()]
    return own[np.argpartition(points @ (other - far), len(own) // 2)]


class BallTree:
    """Nodes as arrays: centre, radius, children (none: a leaf), and the rows of a leaf."""

    def __init__(self, rows: np.ndarray):
        self.order = np.arange(len(rows))
        self.centre, self.radius, self.child, self.span = [], [], [], []
        todo: list[tuple[int, int, int | None]] = [(0, len(rows), None)]
        while todo:
            a, b, parent = todo.pop()
            points = rows[self.order[a:b]]
            c = points.mean(axis=0)
            if parent is not None:
                self.child[parent].append(len(self.span))
            self.centre.append(c)
            self.radius.append(math.sqrt(float(((points - c) ** 2).sum(axis=1).max())))
            self.child.append([])
            self.span.append((a, b))
            if b - a > LEAF and self.radius[-1] > 0:
                self.order[a:b] = _halves(points, self.order[a:b])
                me = len(self.span) - 1
                todo += [(a, (a + b) // 2, me), ((a + b) // 2, b, me)]
        self.rows = rows[self.order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def bounds(self, q: np.ndarray, node: int = 0) -> np.ndarray:
        """What no row of a node can exceed, for each row of ``q``."""
        size = np.sqrt((q * q).sum(axis=-1))
        return q @ self.centre[node] + size * self.radius[node] * (1 + 1e-9) + 1e-6 * (1 + size)

    def search(self, q: np.ndarray, own: np.ndarray, names: list[tuple[int, int]], found: list[list], k: int) -> None:
        """Branch and bound for all queries (rows of ``q``) at once.

        A node is opened for the queries whose bound reaches their current k-th score, the child with the
        larger bounds first. found: of each query a heap of its k best (score, -id, row), the
        worst on top; names: (id, row) in the tree's order; own: the queries' rows.
        """
        worst = np.array([h[0][0] if len(h) == k else -math.inf for h in found])
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, ask = stack.pop()
            ask = ask[self.bounds(q[ask], node) >= worst[ask]]
            if not len(ask):
                continue
            if self.child[node]:
                stack += [(c, ask) for c in sorted(self.child[node], key=lambda c: float(self.bounds(q[ask], c).mean()))]
                continue
            a, b = self.span[node]
            score = q[ask] @ self.rows[a:b].T
            hit = score >= worst[ask, None]
            for r in np.flatnonzero(hit.any(axis=1)).tolist():
                i = int(ask[r])
                best, mine = found[i], int(own[i])
                for j in np.flatnonzero(hit[r]).tolist():
                    name, row = names[a + j]
                    entry = (int(score[r, j]), -name, row)
                    if row == mine:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    worst[i] = best[0][0]


class Shard:
    """The vectors of a shard, without the copies of one vector that can reach no result."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, v: np.ndarray, k: int):
        order = np.lexsort((ids, *v.T)) if v.shape[1] else np.argsort(ids)
        v = v[order]
        new = np.concatenate(([True], (v[1:] != v[:-1]).any(axis=1)))
        place = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
        keep = order[place <= k]  # k others at most, and the query itself, of each vector
        self.ids, self.row, self.v = ids[keep], row[keep], v[place <= k]
        self.largest = max(float(np.abs(self.v).max(initial=0)), 1.0)
        self.tree = BallTree(self.v.astype(np.float64))
        self.names = list(zip(self.ids[self.tree.order].tolist(), self.row[self.tree.order].tolist()))

    def best(self, q: np.ndarray, own: np.ndarray, found: list[list], k: int) -> None:
        """Adds to ``found``, a heap of the k best for each query, what this shard has."""
        x = q.astype(np.float64)
        exact = self.largest * max(float(np.abs(x).max(initial=0)), 1.0) * max(1, q.shape[1]) < _EXACT  # then doubles hold every score
        if exact:
            self.tree.search(x, own, self.names, found, k)
            return
        for i in range(len(q)):
            score = (self.v.astype(object) @ q[i].astype(object)).tolist()
            for entry in heapq.nlargest(k, ((s, -a, r) for s, a, r in zip(score, self.ids.tolist(), self.row.tolist()) if r != own[i])):
                if len(found[i]) < k:
                    heapq.heappush(found[i], entry)
                elif entry > found[i][0]:
                    heapq.heapreplace(found[i], entry)


def _matrix(column, n: int) -> np.ndarray:
    """Vectors, given as little-endian 64-bit integers, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(n, -1)


def _rows_out(query: list[int], row: list[int], found: list[list]) -> dict:
    flat = [(i, r, *e) for i, r, h in zip(query, row, found) for e in h]
    if any(not -_LONG <= x[2] < _LONG for x in flat):
        raise ValueError("a score does not fit in 64 bits")
    return {"q_row": pa.array([x[1] for x in flat], pa.int64()), "query_id": pa.array([x[0] for x in flat], pa.int64()), "vec_id": pa.array([-x[3] for x in flat], pa.int64()), "score": pa.array([x[2] for x in flat], pa.int64()), "row": pa.array([x[4] for x in flat], pa.int64())}


_FOUND = "q_row long, query_id long, vec_id long, score long, row long"


def _integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dim, v) of the rows that take part; v: the integers as bytes."""

    def run(batches):
        for batch in batches:
            ids, vs, dims = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.values
                if i is None or x is None or x.null_count:
                    continue
                y = np.floor(scale * np.asarray(x, np.float64))
                if np.isfinite(np.asarray(x, np.float64)).all():
                    if not (np.abs(y) < 2.0**62).all():
                        raise ValueError(f"a component of {i} is too large")
                    ids.append(i)
                    vs.append(y.astype("<i8").tobytes())
                    dims.append(len(y))
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "dim": pa.array(dims, pa.int32()), "v": pa.array(vs, pa.binary())})

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(lean(run), "vec_id long, dim int, v binary")


def _centres(rows: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """Of the vector lengths in a sample of ``SAMPLE`` rows (those of least hash) the leaves of a ball tree."""
    out = {}
    sample = rows.select("dim", "v").orderBy(F.xxhash64("row")).limit(SAMPLE).toArrow()
    leaves = min(TOP_SHARDS, max(1, round(rows.count() / shard_rows)))
    dims = np.asarray(sample.column("dim"))
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        points = _matrix(sample.column("v").take(pa.array(at)), len(at)).astype(np.float64)
        groups = [np.arange(len(at))]
        while len(groups) < max(1, leaves * len(at) // len(dims)):
            largest = max(range(len(groups)), key=lambda g: len(groups[g]))
            own = groups.pop(largest)
            if len(own) < 2:
                groups.append(own)
                break
            own = _halves(points[own], own)
            groups += [own[: len(own) // 2], own[len(own) // 2 :]]
        out[d] = np.stack([points[g].mean(axis=0) for g in groups])
    return out


def _in_shards(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Adds leaf and shard (of the leaf's shards, by hash); rows of a shard are neighbours in the table."""
    sent = rows.sparkSession.sparkContext.broadcast(_centres(rows, shard_rows))

    def deal(batches):
        for batch in batches:
            dim, leaf = np.asarray(batch.column("dim")), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dim).tolist():
                at, c = np.flatnonzero(dim == d), sent.value.get(d)
                if c is not None and d:
                    x = _matrix(batch.column("v").take(pa.array(at)), len(at)).astype(np.float64)
                    leaf[at] = (0.5 * (c * c).sum(axis=1) - x @ c.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    leafed = staged(rows.mapInArrow(lean(deal), "row long, vec_id long, dim int, v binary, leaf int"), "leaves")
    sizes = leafed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    sharded = leafed.join(sizes, ["dim", "leaf"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")).drop("shards")
    out = staged(sharded.repartition("dim", "leaf", "shard").sortWithinPartitions("dim", "leaf", "shard"), "shards")
    discard(leafed)
    return out


def top_k(vectors: DataFrame, is_query, *, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row for which ``is_query(vec_id)``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = staged(_integers(vectors, scale).withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "dim", "v"), "vectors")
    shards = _in_shards(rows, shard_rows)
    asking = is_query(F.col("vec_id"))

    def own_shards(batches, work):
        """Calls ``work(dim, rows)`` for the rows of each shard, as far as they stand together in a task."""
        held, key, n = [], None, 0
        for batch in batches:
            here = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "leaf", "shard"))))
            low = 0
            while low < len(here):
                high = next((i for i in range(low, len(here)) if here[i] != here[low]), len(here))
                if held and (here[low] != key or n >= 2 * shard_rows):
                    yield from work(pa.Table.from_batches(held).combine_chunks())
                    held, n = [], 0
                key = here[low]
                held.append(batch.slice(low, high - low))
                n += high - low
                low = high
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    def parts(t: pa.Table):
        return np.asarray(t.column("vec_id")), np.asarray(t.column("row")), _matrix(t.column("v"), t.num_rows)

    def at_home(batches):
        def work(t):
            ask = np.flatnonzero(np.asarray(t.column("asks")))
            if not len(ask):
                return
            ids, row, v = parts(t)
            found = [[] for _ in ask]
            Shard(ids, row, v, k).best(v[ask], row[ask], found, k)
            yield pa.RecordBatch.from_pydict(_rows_out(ids[ask].tolist(), row[ask].tolist(), found))

        yield from own_shards(batches, work)

    near = staged(shards.withColumn("asks", F.coalesce(asking, F.lit(False))).mapInArrow(lean(at_home), _FOUND), "home")
    bounds = near.groupBy("q_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    queries = staged(rows.where(asking).join(bounds, F.col("row") == F.col("q_row"), "left").select("row", "vec_id", "dim", "v", "least"), "queries")
    size = queries.agg(F.sum(F.length("v") + 32)).first()[0] or 0
    blocks = -(-size // query_bytes)
    order = F.struct((-F.col("score")).alias("s"), "vec_id", "row")
    best = near
    for b in range(blocks):  # stated queries in blocks against all rows
        block = queries.where(F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)) == b).toArrow()
        sent = spark.sparkContext.broadcast(block)

        def away(batches, sent=sent):
            asked = sent.value
            dims, least = np.asarray(asked.column("dim")), asked.column("least").to_pylist()
            by_dim = {}
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                t = asked.take(pa.array(at))
                # k stand-ins of the k-th score at home bound the search; they lose ties and are not sent.
                by_dim[d] = (*parts(t), [[(least[i], -_LONG, -1)] * k if least[i] is not None else [] for i in at.tolist()])

            def work(t):
                d = t.column("dim")[0].as_py()
                if d in by_dim:
                    _, own, q, found = by_dim[d]
                    Shard(*parts(t), k).best(q, own, found, k)
                return iter(())

            yield from own_shards(batches, work)
            for ids, own, _, found in by_dim.values():
                for low in range(0, len(found), 1000):
                    yield pa.RecordBatch.from_pydict(_rows_out(ids[low : low + 1000].tolist(), own[low : low + 1000].tolist(), [[e for e in h if e[2] >= 0] for h in found[low : low + 1000]]))

        best = best.union(staged(shards.mapInArrow(lean(away), _FOUND), "away"))
    # A query has k rows a task at most; the home shard's come twice.
    ranked = best.distinct().groupBy("q_row", "query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % EVERY == 0)


ORACLE_SQL = f"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
  FROM rows q JOIN rows e ON q.vec_id <> e.vec_id WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= {K}
"""
