"""Phrase collocation mining by direct-address tiling.

Frequent words get ids by rank of frequency within their language. A phrase of m words is a pair:
its first m - 1 words (for m = 2 a word, else a frequent phrase, ranked anew by frequency) and one
more word. A pair's two ranks are its address in a table cut into tiles of ``TILE`` squared cells:
tiles that many occurrences fall into are counted densely by ``numpy.bincount``, all others
as sorted coordinates with counts. Counts of tasks are added up by Spark, what is frequent is ranked
and is the left side of the next length.

* Words: after lower-casing A-Z texts are cut at ``[.,;:!?\\x0A-\\x0D]``, pieces into ``[^\\x20\\x09]+``.
* A phrase can only be frequent if all of its parts are, so rarer words break a piece, and a longer
  phrase is looked at only where both of its parts one word shorter may be frequent.
* Null and empty texts have no words; a null language is ``und``; a repeated row counts as often
  as it occurs. Without frequent phrases, and for an empty table, the result is empty.
* Ties: cuts of equal score go to the shorter first part, phrases of equal score and count by bytes.
* Columns beside ``text`` and ``lang`` are not read.

Nothing that grows with the corpus is broadcast: only the ``HEAD`` most frequent words and phrases
get ranks (shorter than ``HEAD_BYTES``), and a set of frequent ids is a bit set of bounded size.
Words beyond that have 63-bit hashes as ids; should two words share one, all is done again with
other hashes. Phrases beyond the head are counted as sorted coordinates. Results stay the same.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohorta.llm.common import bounded_batches, discard, lean, mix, slices, staged, text_bytes

LONGEST, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Words, and phrases of each length, that get ranks and so may lie in dense tiles.
HEAD, HEAD_BYTES = 100_000, 64
#: Cells of a tile's side (a power of two), dense tiles of a task at most, and occurrences of one slice that make a tile dense.
TILE, TILES, DENSE = 1024, 16, 1 << 14
#: Ids of a row of ``sequences``, and of a slice that is counted at once.
ROW, SLICE = 4096, 1 << 20
#: Rows of sparse tiles that a task holds before it sends them on.
HELD = 1 << 21
#: Bits of the number of cells that phrases of 3 words or more are first counted in, and of the number of ranges of cells.
CELL_BITS, CELL_RANGES = 24, 6
#: A bit set of frequent ids has 16 bits an id, up to so many bits.
MOST_BITS = 1 << 26
#: Languages whose totals are broadcast; more are joined by shuffle.
MOST_SENT = 10_000
UNKNOWN = "und"
_BREAKS = b".,;:!?\n\v\f\r"
_CUT = bytes(10 if b in _BREAKS else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))


def _by_language(batch: pa.RecordBatch):
    """(language, its texts joined by a break, cut and lower-cased) of a batch of (lang, text)."""
    raw, start, end = text_bytes(batch.column(1))
    raw = raw.tobytes().translate(_CUT)
    parts: dict[str, list[bytes]] = {}
    for g, a, b in zip(batch.column(0).to_pylist(), start.tolist(), end.tolist()):
        parts.setdefault(g, []).append(raw[a:b])
    for g, texts in parts.items():
        yield g, b"\n".join(texts)


def _hashed(lang: str, word: bytes, seed: int) -> int:
    """The id of a word without a rank: negative, from a cryptographic hash."""
    h = hashlib.blake2b(lang.encode() + b"\0" + word, digest_size=8, salt=seed.to_bytes(4, "little")).digest()
    return min(int.from_bytes(h, "little") | -(1 << 63), -2)


def vocabulary(docs: DataFrame, seed: int = 0) -> DataFrame:
    """lang, word, h (its hash id) and f (how often it occurs) of all words."""

    def count(batches):
        found: dict[str, Counter] = {}
        size = 0

        def rows():
            flat = [(g, w, n) for g, c in found.items() for w, n in c.items()]
            for low in range(0, len(flat), 20_000):
                part = flat[low : low + 20_000]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([g for g, _, _ in part], pa.string()), "word": pa.array([w for _, w, _ in part], pa.binary()).cast(pa.string()),
                    "h": pa.array([_hashed(g, w, seed) for g, w, _ in part], pa.int64()), "c": pa.array([n for _, _, n in part], pa.int64()),
                })

        for batch in batches:
            for part in slices(batch, 2 << 20):
                for g, text in _by_language(part):
                    found.setdefault(g, Counter()).update(text.split())
                    size += len(text)
                if size > 32 << 20 or sum(map(len, found.values())) > 200_000:
                    yield from rows()
                    found, size = {}, 0
        yield from rows()

    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(lean(count), "lang string, word string, h long, c long")
    return rows.groupBy("lang", "word", "h").agg(F.sum("c").alias("f"))


class Head:
    """The most frequent words of all languages: their ids, (language's number + 1) << 32 | rank within it."""

    def __init__(self, rows: list):
        self.langs: dict[str, int] = {}
        self.ids: dict[tuple[str, bytes], int] = {}
        ranks: Counter = Counter()
        for lang, word in rows:
            code = self.langs.setdefault(lang, len(self.langs))
            self.ids[lang, word.encode()] = code + 1 << 32 | ranks[lang]
            ranks[lang] += 1


class _Ids(dict):
    """Ids of one language's words as they come up: 0 if a word is surely rare, kept up to a bound."""

    def __init__(self, lang: str, ids: dict, tail, seed: int):
        self.lang, self.ids, self.tail, self.seed = lang, ids, tail, seed
        self[b"\n"], self[b""] = 0, -1

    def __missing__(self, word: bytes) -> int:
        out = self.ids.get((self.lang, word))
        if out is None:
            out = 0
            if self.tail is not None:
                h = _hashed(self.lang, word, self.seed)
                if self.tail.maybe(np.array([h], np.int64).view(np.uint64))[0]:
                    out = h
        if len(word) <= 256:
            if len(self) > 50_000:
                self.clear()
                self.__init__(self.lang, self.ids, self.tail, self.seed)
            self[word] = out
        return out


class Bits:
    """A bit set of hashes: whether one is in it, or perhaps is. Its size is bounded; beyond that it only spares less."""

    PROBES = 4

    def __init__(self, ids: DataFrame, columns: list[str], n: int):
        size = 1 << 16
        while size < min(16 * n, MOST_BITS):
            size *= 2

        def fill(batches):
            bits = np.zeros(size // 8, np.uint8)
            for batch in batches:
                h = tuple_hash([np.asarray(batch.column(k)) for k in range(len(columns))])
                for j in range(Bits.PROBES):
                    at = Bits._place(h, j, size)
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            words = bits.view(np.int64)
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "word": words[at]})

        table = np.zeros(size // 64, np.int64)
        found = ids.select(*columns).mapInArrow(lean(fill), "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # size / 64 rows at most
        table[np.asarray(found.column("at"))] = np.asarray(found.column("word"))
        self.bits = table.view(np.uint8)

    @staticmethod
    def _place(h: np.ndarray, probe: int, size: int) -> np.ndarray:
        return (mix(h + np.uint64(probe)) & np.uint64(size - 1)).astype(np.int64)

    def maybe(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        left = np.arange(len(h))
        for j in range(self.PROBES):  # each probe looks at what the last one has left
            at = self._place(h[left], j, 8 * len(self.bits))
            left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        out[left] = True
        return out


def tuple_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row; of a single column the numbers themselves, which are hashes already."""
    if len(columns) == 1:
        return columns[0].astype(np.int64).view(np.uint64)
    out = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.int64).view(np.uint64) + np.uint64(1))
    return out


def sequences(docs: DataFrame, head: Head, tail: Bits | None, seed: int) -> DataFrame:
    """The corpus as rows of ids (0: a break or rare words) and ``own``, at how many of them a phrase may begin.

    Each row ends with the ids that a phrase begun in it may need, which belong to the next row.
    """
    sent = docs.sparkSession.sparkContext.broadcast((head.ids, tail))

    def number(batches):
        ids, tail = sent.value
        known: dict[str, _Ids] = {}
        for batch in batches:
            for part in slices(batch, 2 << 20):
                for g, text in _by_language(part):
                    if g not in known and len(known) >= 8:
                        known.clear()
                    get = known.setdefault(g, _Ids(g, ids, tail, seed)).__getitem__
                    tokens = text.replace(b"\n", b" \n ").split(b" ")
                    x = np.fromiter(map(get, tokens), np.int64, len(tokens))
                    x = x[x != -1]
                    set_ = np.concatenate(([False], x != 0, [False]))
                    x = x[(set_[1:-1] & (set_[:-2] | set_[2:])) | (~set_[1:-1] & set_[:-2])]  # single words are no phrase; one break is enough
                    rows = [x[low : low + ROW + LONGEST - 1] for low in range(0, len(x), ROW)]
                    if rows:
                        at = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                        own = [min(ROW, len(x) - low) for low in range(0, len(x), ROW)]
                        yield pa.RecordBatch.from_pydict({"ids": pa.ListArray.from_arrays(at, np.concatenate(rows)), "own": pa.array(own, pa.int32())})

    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(lean(number), "ids array<long>, own int")


class Tiles:
    """Counts of phrases of m words: dense tiles for the pairs of ranks that are met often, sorted coordinates for the rest."""

    def __init__(self, m: int, left: tuple | None, parts: Bits | None, cells: np.ndarray | None = None):
        """left: hashes in order, ids by column, and ranks of frequent phrases of m - 1 words (m > 2); cells: of ``frequent_cells``."""
        self.m, self.left, self.parts, self.cells, self.dense, self.sparse = m, left, parts, cells, {}, []

    def ranks(self, x: list[np.ndarray]) -> np.ndarray:
        """The rank of each left side within its language, or -1."""
        if self.m == 2:
            return np.where(x[0] > 0, x[0] & 0xFFFFFFFF, -1)
        hashes, table, rank = self.left
        if not len(hashes):
            return np.full(len(x[0]), -1)
        at = np.minimum(np.searchsorted(hashes, tuple_hash(x[:-1])), len(hashes) - 1)
        same = np.logical_and.reduce([table[j][at] == x[j] for j in range(self.m - 1)])
        return np.where(same, rank[at], -1)

    def phrases(self, ids: np.ndarray, may_begin: np.ndarray) -> list[np.ndarray]:
        """The ids, by column, of a slice's phrases of m words whose parts may be frequent."""
        m = self.m
        n = max(len(ids) - m + 1, 0)
        ok = may_begin[:n].copy()
        for j in range(m):
            ok &= ids[j : j + n] != 0
        if self.parts is not None and n:
            frequent = self.parts.maybe(tuple_hash([ids[j : n + 1 + j] for j in range(m - 1)]))
            ok &= frequent[:n] & frequent[1 : n + 1]
        at = np.flatnonzero(ok)
        x = [ids[at + j] for j in range(m)]
        if self.cells is not None:
            cell = _cell(x, 8 * len(self.cells))
            may = (self.cells[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            x = [c[may] for c in x]
        return x

    def add(self, ids: np.ndarray, may_begin: np.ndarray):
        """Counts one slice; gives rows (ids by column, counts) of sparse tiles when more than HELD are held."""
        x = self.phrases(ids, may_begin)
        if not len(x[0]):
            return
        rank, last = self.ranks(x), x[-1]
        dense = (rank >= 0) & (last > 0)
        low = np.int64(TILE - 1)
        tile = np.where(dense, (last >> 32) << 40 | rank // TILE << 20 | (last & 0xFFFFFFFF) // TILE, -1)
        cell = (rank & low) * TILE + (last & low)
        for t, n in zip(*(a.tolist() for a in np.unique(tile[dense], return_counts=True))):
            if t not in self.dense and n >= DENSE and len(self.dense) < TILES:
                self.dense[t] = np.zeros(TILE * TILE, np.int64)
            if t in self.dense:
                here = tile == t
                self.dense[t] += np.bincount(cell[here], minlength=TILE * TILE)
                tile[here] = -2
        rest = tile != -2
        if rest.any():
            self.sparse.append(self._sorted([c[rest] for c in x], np.ones(int(rest.sum()), np.int64)))
            if sum(len(c) for _, c in self.sparse) > HELD:
                whole = self._whole()
                if len(whole[1]) > HELD // 2:
                    yield whole
                else:
                    self.sparse = [whole]

    def _whole(self) -> tuple[list[np.ndarray], np.ndarray]:
        """What the slices since the last time have in their sparse tiles, added up."""
        columns, counts = zip(*self.sparse)
        self.sparse = []
        return self._sorted([np.concatenate(c) for c in zip(*columns)], np.concatenate(counts))

    @staticmethod
    def _sorted(x: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows in order, equal ones added up."""
        order = np.lexsort(x[::-1])
        x = [c[order] for c in x]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in x])
        at = np.flatnonzero(new)
        return [c[at] for c in x], np.add.reduceat(n[order], at)

    def close(self):
        """The rows of the dense tiles, and of the sparse ones that are still held."""
        if self.sparse:
            yield self._whole()
        for t, count in self.dense.items():
            at = np.flatnonzero(count)
            code, row, col = t >> 40, (t >> 20 & (1 << 20) - 1) * TILE + at // TILE, (t & (1 << 20) - 1) * TILE + at % TILE
            if self.m == 2:
                first = [code << 32 | row]
            else:
                _, table, rank = self.left
                lang = table[0] >> 32 == code
                by_rank = np.flatnonzero(lang)[np.argsort(rank[lang])]
                first = [c[by_rank[row]] for c in table]
            yield [*first, code << 32 | col], count[at]


def _slices(batches):
    """The rows of ``sequences`` in slices of about SLICE ids: ids, and where phrases may begin."""
    held, size = [], 0
    for batch in batches:
        column, own = batch.column(0), np.asarray(batch.column(1))
        at = np.asarray(column.offsets).astype(np.int64)
        flat = np.asarray(column.values)
        for k in range(len(own)):
            held.append((flat[at[k] : at[k + 1]], int(own[k])))
            size += len(held[-1][0]) + 1
            if size >= SLICE:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _cell(x: list[np.ndarray], cells: int) -> np.ndarray:
    """The cell of each phrase, given by its ids by column; ``cells`` is a power of two."""
    return (tuple_hash(x) & np.uint64(cells - 1)).astype(np.int64)


def frequent_cells(rows: DataFrame, m: int, parts: Bits, least: int) -> np.ndarray:
    """A bit set of the cells that phrases of m ids whose parts may be frequent fall into ``least`` times or more.

    A phrase of any other cell is rare, so it need not be counted by itself. Each task's counts, cut
    off at ``least``, go to ranges of cells in packed form; cells are of a fixed number, so a corpus
    that outgrows them is only spared less.
    """
    sent = rows.sparkSession.sparkContext.broadcast(parts)
    ranges, width, kind = 1 << CELL_RANGES, 1 << CELL_BITS - CELL_RANGES, np.min_scalar_type(least)

    def summed(held):
        cell, place = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return cell, np.bincount(place, np.concatenate([n for _, n in held]), len(cell)).astype(np.int64)

    def collect(batches):
        tiles, held = Tiles(m, None, sent.value), []

        def out():
            cell, n = summed(held)
            edge = np.searchsorted(cell, np.arange(0, width * (ranges + 1), width))
            cell, n = (cell % width).astype(np.uint32), np.minimum(n, least).astype(kind)
            some = np.flatnonzero(edge[1:] > edge[:-1])
            cut = [(a, b) for a, b in zip(edge[some].tolist(), edge[some + 1].tolist())]
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "cells": pa.array([cell[a:b].tobytes() for a, b in cut], pa.binary()), "counts": pa.array([n[a:b].tobytes() for a, b in cut], pa.binary())})

        for part in _slices(batches):
            cell, n = np.unique(_cell(tiles.phrases(*part), ranges * width), return_counts=True)
            if len(cell):
                held.append((cell, n))
            if sum(len(c) for c, _ in held) > HELD:
                held = [summed(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from out()
                    held = []
        if held:
            yield from out()

    def flags(batches):
        def out(part, count):
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "flags": pa.array([np.packbits(count >= least, bitorder="little").tobytes()], pa.binary())})

        now, count = None, None
        for batch in batches:
            for part, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if part != now:
                    if now is not None:
                        yield out(now, count)
                    now, count = part, np.zeros(width, np.int64)
                count[np.frombuffer(cells.as_buffer(), np.uint32)] += np.frombuffer(counts.as_buffer(), kind)
        if now is not None:
            yield out(now, count)

    packed = rows.mapInArrow(lean(collect), "part int, cells binary, counts binary").repartition("part").sortWithinPartitions("part")
    table = np.zeros((ranges, width // 8), np.uint8)
    for r in packed.mapInArrow(lean(flags), "part int, flags binary").toLocalIterator():  # a bit a cell in all
        table[r["part"]] = np.frombuffer(r["flags"], np.uint8)
    return table.reshape(-1)


def phrase_counts(rows: DataFrame, m: int, left: tuple | None, parts: Bits | None, cells: np.ndarray | None = None) -> DataFrame:
    """w1 .. wm and f, how often each phrase of m ids occurs, of phrases whose parts and cells may be frequent."""
    names = [f"w{j + 1}" for j in range(m)]
    sent = rows.sparkSession.sparkContext.broadcast((left, parts, cells))

    def count(batches):
        tiles = Tiles(m, *sent.value)

        def out(found):
            for x, c in found:
                for low in range(0, len(c), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v[low : low + 100_000].astype(np.int64)) for v in (*x, c)], names=[*names, "c"])

        for part in _slices(batches):
            yield from out(tiles.add(*part))
        yield from out(tiles.close())

    counted = rows.mapInArrow(lean(count), ", ".join(f"{c} long" for c in [*names, "c"]))
    return counted.groupBy(*names).agg(F.sum("c").alias("f"))


def _joined(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows one after the other with a break after each, and where phrases may begin."""
    ids = np.zeros(sum(len(x) + 1 for x, _ in rows), np.int64)
    begin, at = np.zeros(len(ids), bool), 0
    for x, own in rows:
        ids[at : at + len(x)] = x
        begin[at : at + own] = True
        at += len(x) + 1
    return ids, begin


def _ranked(counts: DataFrame, m: int) -> tuple:
    """The HEAD most frequent phrases whose words all have ranks: hashes in order, ids by column, rank within the language."""
    names = [f"w{j + 1}" for j in range(m)]
    top = counts.where(F.least(*names, F.lit(1 << 62)) > 0).orderBy(F.desc("f"), *names).select(*names).limit(HEAD).toArrow()
    table = [np.asarray(c, np.int64) for c in top.columns]
    code, rank = table[0] >> 32, np.zeros(len(table[0]), np.int64)
    for c in np.unique(code):
        rank[code == c] = np.arange((code == c).sum())
    h = tuple_hash(table)
    order = np.argsort(h, kind="stable")
    return h[order], [c[order] for c in table], rank[order]


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, seed: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """Words (id, lang, word, f, n: words of the language), and of each length the frequent phrases (w1 .. wm, f)."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases of 2 to {LONGEST} words")
    bounded_batches(docs.sparkSession)
    every = staged(vocabulary(docs, seed), "vocabulary")
    frequent = every.where(F.col("f") >= least)
    in_head = F.octet_length("word") <= HEAD_BYTES
    top = frequent.where(in_head).orderBy(F.desc("f"), "lang", "word").limit(HEAD).select("lang", "word").collect()
    head = Head(top)
    ranks = docs.sparkSession.createDataFrame([(g, w.decode(), i) for (g, w), i in head.ids.items()], "lang string, word string, id long")
    n = every.groupBy("lang").agg(F.sum("f").alias("n"))
    n = F.broadcast(n) if n.count() <= MOST_SENT else n
    words = staged(frequent.join(F.broadcast(ranks), ["lang", "word"], "left").join(n, "lang").select(F.coalesce("id", "h").alias("id"), "lang", "word", "f", "n"), "words")
    hashed = words.where("id < 0").select("id")
    beyond, tail = hashed.count(), None
    if beyond:
        shared = every.select(F.col("h").alias("id"), "lang", "word").join(hashed, "id", "left_semi").groupBy("id").count().where("count > 1")
        if not shared.isEmpty():
            discard(every, words)
            return frequent_phrases(docs, least=least, longest=longest, seed=seed + 1)
        tail = Bits(hashed, ["id"], beyond)
    discard(every)
    rows = staged(sequences(docs, head, tail, seed), "sequences")
    found, left, parts = [], None, None
    for m in range(2, longest + 1):
        cells = frequent_cells(rows, m, parts, least) if parts is not None else None
        counts = staged(phrase_counts(rows, m, left, parts, cells).where(F.col("f") >= least), f"phrases{m}")
        size = counts.count()
        if not size:
            discard(counts)
            break
        found.append(counts)
        if m < longest:
            left, parts = _ranked(counts, m), Bits(counts, [f"w{j + 1}" for j in range(m)], size)
    discard(rows)
    return words, found


def _listed(counts: DataFrame) -> DataFrame:
    return counts.select(F.array(*[c for c in counts.columns if c != "f"]).alias("p"), "f")


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases, by their weakest cut.

    A phrase goes if a longer one that holds it occurs ``share`` hundredths as often or more.
    """
    words, found = frequent_phrases(docs, least=least, longest=longest)
    shape = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if not found:
        return docs.sparkSession.createDataFrame([], shape)
    phrases = [_listed(c) for c in found]
    candidates = phrases[0]
    parts = words.select(F.array("id").alias("p"), "f")
    for c in phrases[1:]:
        candidates = candidates.unionAll(c)
    for c in phrases[: longest - 2]:
        parts = parts.unionAll(c)
    # Whatever holds a phrase holds one of one word more as often, so those are enough.
    inside = candidates.where(F.size("p") > 2).select(F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"), "f")
    kept = candidates.join(inside.groupBy("p").agg(F.max("f").alias("longer")), "p", "left").where(F.expr(f"longer is null or 100 * longer < {share} * f")).select("p", F.col("f").alias("a"))
    cuts = kept.select("p", "a", F.col("p")[0].alias("id"), F.explode(F.expr("sequence(1, size(p) - 1)")).alias("k")).join(words.select("id", "lang", "n"), "id")
    cuts = cuts.select("p", "a", "lang", "n", "k", F.expr("slice(p, 1, k)").alias("first"), F.expr("slice(p, k + 1, size(p) - k)").alias("rest"))
    cuts = cuts.join(parts.select(F.col("p").alias("first"), F.col("f").alias("l")), "first").join(parts.select(F.col("p").alias("rest"), F.col("f").alias("r")), "rest")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n")).withColumn("below", wide("l") * wide("r")).withColumn("score", F.expr("above div below"))
    scored = cuts.groupBy("p").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang")).alias("s")).select("p", "s.*")
    order = [F.desc("score"), F.desc("a")]
    first = Window.partitionBy("lang", "deal").orderBy(*order)
    near = scored.withColumn("deal", F.pmod(F.xxhash64("p"), F.lit(64))).withColumn("rank", F.rank().over(first)).where(F.col("rank") <= top)
    near = near.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)  # 64 * top rows a language, and ties
    spelled = near.select("p", "lang", "a", "l", "r", "n", "score", F.posexplode("p").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("p", "lang", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))  # LONGEST words at most
    last = Window.partitionBy("lang").orderBy(*order, "phrase")
    named = spelled.withColumn("phrase", F.concat_ws(" ", F.col("w.word"))).withColumn("rank", F.row_number().over(last).cast("long"))
    out = staged(named.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(words, *found)
    return out


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(docs: list[tuple], least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> list[tuple]:
    """The same from every window of every piece of (text, lang); for small inputs."""
    import re

    count: dict[str, Counter] = {}
    for text, lang in docs:
        c = count.setdefault(UNKNOWN if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(x.lower() if x.isascii() else x for x in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                c.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in count.items():
        n, rows = sum(v for p, v in c.items() if len(p) == 1), []
        frequent = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        gone = {p[i:j] for p, a in frequent.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= share * c[p[i:j]]}
        for p, a in frequent.items():
            if p not in gone:
                score, k = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return out


ORACLE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) u(piece)),
g AS (SELECT lang, w[CAST(i + 1 AS BIGINT) : CAST(i + m AS BIGINT)] AS p FROM w, unnest(range(1, 6)) v(m), unnest(range(0, greatest(0, len(w) - m + 1))) u(i)),
f AS (SELECT lang, p, count(*) AS f, len(p) AS m FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 100),
inside AS (SELECT DISTINCT c.lang, s.p FROM c, unnest(range(0, m)) a(i), unnest(range(i + 2, m + 1)) b(j) JOIN f s ON s.lang = c.lang AND s.p = c.p[CAST(i + 1 AS BIGINT) : CAST(j AS BIGINT)] WHERE j - i < c.m AND 100 * c.f >= 100 * s.f),
k AS (SELECT lang, p, f, m FROM c ANTI JOIN inside USING (lang, p)),
cut AS (SELECT k.lang, k.p, k.f AS a, i, x.f AS l, y.f AS r, n.n, (1000 * CAST(k.f AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score FROM k, unnest(range(1, k.m)) u(i)
  JOIN f x ON x.lang = k.lang AND x.p = k.p[1 : CAST(i AS BIGINT)] JOIN f y ON y.lang = k.lang AND y.p = k.p[CAST(i + 1 AS BIGINT) : CAST(k.m AS BIGINT)] JOIN n ON n.lang = k.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, i) = 1),
named AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best)
SELECT * FROM named WHERE rank <= 2000
"""
