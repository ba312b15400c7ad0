"""Language ID by hyperdimensional profiles.

Each letter has a random +1/-1 vector of ``DIM`` components; an n-gram vector binds the
vectors of its letters, each rotated by its place; a text bundles (adds) the vectors of its
n-grams, a language bundles the unit vectors of its training texts, and a text gets the
language of largest cosine.

* Letters are Unicode letters (general category L), lower-cased, each with a vector of its own;
  any run of other characters is one blank, and a text has a blank before and after.
* A text that is null, empty or without a letter has language ``und`` and score 0; so has every
  text if there is nothing to learn from.
* ``known_language`` keeps the texts whose cosine reaches the floor of their language and length:
  the least cosine of the labelled texts that got this language and have as many letters or
  more, in powers of two. So labelled texts pass. Texts shorter than any labelled one, or of a
  language that no labelled text got, have no floor. Without prototypes texts with a letter pass.
* There may be any number of languages: prototypes go to the executors in blocks of about
  ``BLOCK_LANGUAGES``, and what a pass has found is written before the next one starts.
* Ties go to the language that sorts first. Repeated rows count as often as they occur.
* Input columns are kept; a result column takes the place of an input column of its name.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import bounded_batches, discard, fold, kept, lean, staged

DIM, NGRAM, SEED = 1024, 3, 20240501
#: Code points fit in so many bits, so three letters fit in one 64-bit key.
_BITS = 21
#: Softmax temperature that turns cosines into a score.
SHARPNESS = 12.0
#: About the most prototypes of one broadcast (4 KB each).
BLOCK_LANGUAGES = 4096
#: Most languages whose floors (some 0.5 KB each) are broadcast; more are joined by shuffle.
MOST_SENT = 10_000
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of general category L."""
    return any(map(str.isalpha, text)) if text else False


@functools.cache
def _symbols() -> np.ndarray:
    """Of each code point itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int32)


class Profiles:
    """Bundles of n-gram vectors; vectors of n-grams and letters seen are kept, up to a bound.

    N-grams are taken ``SLICE`` at a time, so texts of many different ones take no more memory.
    """

    MOST, SLICE, LETTERS = 16_384, 8_192, 32_768

    def __init__(self, dim: int = DIM, ngram: int = NGRAM, seed: int = SEED):
        if not 1 <= ngram <= 63 // _BITS:
            raise ValueError(f"n-grams of 1 to {63 // _BITS} letters")
        self.dim, self.ngram, self.seed = dim, ngram, seed
        self.letters: dict[int, np.ndarray] = {}
        self.symbols = _symbols()
        self.keys = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        """The random vector of a letter (0: the blank), the same in every worker."""
        if code not in self.letters:
            if len(self.letters) >= self.LETTERS:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, np.int8) * 2 - 1
        return self.letters[code]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a text and how often each occurs."""
        s = self.symbols[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s = np.concatenate(([0], s[keep], [0])).astype(np.int64)
        n = len(s) - self.ngram + 1
        key = np.zeros(n, np.int64)
        for j in range(self.ngram):
            key = key << _BITS | s[j : j + n]
        key.sort()
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[cut], np.diff(np.append(cut, n)).astype(np.float32)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Where the vectors of these n-grams stand in ``self.vectors``."""
        new = np.setdiff1d(keys, self.keys)
        if len(new):
            if len(self.keys) + len(new) > self.MOST:
                self.keys, self.vectors, new = self.keys[:0], self.vectors[:0], np.unique(keys)
            made = np.ones((len(new), self.dim), np.int8)
            for j in range(self.ngram):
                code, at = np.unique(new >> _BITS * (self.ngram - 1 - j) & (1 << _BITS) - 1, return_inverse=True)
                made *= np.roll(np.stack([self.letter(c) for c in code.tolist()]), self.ngram - 1 - j, axis=1)[at]
            all_keys = np.concatenate((self.keys, new))
            order = np.argsort(all_keys)
            self.keys, self.vectors = all_keys[order], np.concatenate((self.vectors, made))[order]
        return np.searchsorted(self.keys, keys)

    def bundles(self, texts: list[str]) -> np.ndarray:
        """A unit vector for each text; texts must not be empty."""
        out = np.zeros((len(texts), self.dim), np.float32)
        grams = [self.grams(t) for t in texts]
        for low in range(0, len(texts), 128):
            part = grams[low : low + 128]
            flat, times = np.concatenate([k for k, _ in part]), np.concatenate([n for _, n in part])
            text = np.repeat(np.arange(len(part), dtype=np.int32), [len(k) for k, _ in part])
            order = np.argsort(flat, kind="stable")
            flat, times, text = flat[order], times[order], text[order]
            place = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1])))
            edge = np.searchsorted(place, np.arange(0, place[-1] + 1 + self.SLICE, self.SLICE))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                at, first = place[a:b] - place[a], np.flatnonzero(np.concatenate(([True], flat[a + 1 : b] != flat[a : b - 1])))
                count = np.zeros((len(part), int(at[-1]) + 1), np.float32)
                count[text[a:b], at] = times[a:b]
                where = self.rows(flat[a:b][first])
                out[low : low + 128] += count @ self.vectors[where].astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _profiles(*how) -> Profiles:
    return kept(("profiles", *how), lambda: Profiles(*how))


def learn_languages(labelled: DataFrame, *, dim: int = DIM, ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """Prototypes (lang, prototype: a unit vector) from ``text`` and ``lang``; rows without either, or without letters, teach nothing.

    A task sends one vector a language, whatever it has read; Spark adds them up.
    """

    def bundle(batches):
        made, total = _profiles(dim, ngram, seed), {}

        def out():
            return pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "bundle": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                pairs = [(t, g) for t, g in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()) if has_letter(t)]
                if pairs:
                    for v, (_, g) in zip(made.bundles([t for t, _ in pairs]), pairs):
                        total[g] = total.get(g, 0) + v.astype(np.float64)
                if len(total) >= 1024:
                    yield out()
                    total = {}
        if total:
            yield out()

    bounded_batches(labelled.sparkSession)
    sums = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(lean(bundle), "lang string, bundle array<double>")
    by_dim = sums.select("lang", F.posexplode("bundle").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    whole = by_dim.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))  # ``dim`` rows a language
    return staged(whole.where("size > 0").select("lang", F.transform("v", lambda e: (e["x"] / F.col("size")).cast("float")).alias("prototype")), "prototypes")


def _blocks(prototypes):
    """(languages in order, their vectors as rows) in blocks of bounded size; ``prototypes`` may be a dict of vectors."""
    if isinstance(prototypes, dict):
        names = sorted(prototypes)
        for low in range(0, len(names), BLOCK_LANGUAGES):
            yield names[low : low + BLOCK_LANGUAGES], np.stack([prototypes[g] for g in names[low : low + BLOCK_LANGUAGES]])
        return
    blocks = -(-prototypes.count() // BLOCK_LANGUAGES)
    for k in range(blocks):
        rows = sorted(prototypes.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k).collect())
        if rows:
            yield [r["lang"] for r in rows], np.array([r["prototype"] for r in rows], np.float32)


def identify_language(docs: DataFrame, prototypes, *, dim: int = DIM, ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """Adds lang_pred, lang_cosine (of the best language) and score (0 to 1, softmax of cosines).

    prototypes: what ``learn_languages`` gives, or a dict of unit vectors by language.
    """
    own = {"lang_pred", "lang_cosine", "score"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own])
    bounded_batches(docs.sparkSession)
    out = docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("lang_cosine", F.lit(0.0)).withColumn("score", F.lit(0.0))
    schema = out.schema
    for f in schema.fields[-3:]:
        f.nullable = True
    before = None
    for names, table in _blocks(prototypes):
        if before is not None:  # one pass, with one block, is alive at a time
            out, old = staged(before, "languages"), out
            if hasattr(old, "staged_at"):
                discard(old)
        sent = docs.sparkSession.sparkContext.broadcast((names, table))

        def judge(batches, sent=sent):
            """Here score is the sum of exp(sharpness * cosine) over the languages so far."""
            made, (names, table) = _profiles(dim, ngram, seed), sent.value
            for batch in batches:
                n = batch.num_columns - 3
                pred, cosine, mass = (batch.column(n + k).to_pylist() for k in range(3))
                for low in range(0, batch.num_rows, 256):
                    texts = batch.column("text").slice(low, 256).to_pylist()
                    ok = [i for i, t in enumerate(texts) if has_letter(t)]
                    if not ok:
                        continue
                    cos = made.bundles([texts[i] for i in ok]) @ table.T
                    more = np.exp(SHARPNESS * cos.astype(np.float64)).sum(axis=1)
                    for i, b, x, m in zip(ok, cos.argmax(axis=1).tolist(), cos.max(axis=1).tolist(), more.tolist()):
                        i += low
                        if pred[i] == UNKNOWN and not mass[i] or (-x, names[b]) < (-cosine[i], pred[i]):
                            pred[i], cosine[i] = names[b], x
                        mass[i] += m
                rest = {f.name: batch.column(k) for k, f in enumerate(batch.schema) if k < n}
                yield pa.RecordBatch.from_pydict(rest | {"lang_pred": pa.array(pred, pa.string()), "lang_cosine": pa.array(cosine, pa.float64()), "score": pa.array(mass, pa.float64())})

        before = out.mapInArrow(lean(judge), schema)
    if before is None:
        return out
    share = F.exp(SHARPNESS * F.col("lang_cosine")) / F.col("score")
    return before.withColumn("score", F.when(F.col("score") > 0, F.least(share, F.lit(1.0))).otherwise(0.0))


def _size(text: Column) -> Column:
    """The power of two that a text's letters reach."""
    return F.floor(F.log2(F.greatest(F.length(F.regexp_replace(text, r"\P{L}", "")), F.lit(1)))).cast("int")


def floors(judged: DataFrame) -> DataFrame:
    """Of each language (lang_pred) the least cosine by size of text, as an array ``_floor`` of size and least.

    judged: rows of text, lang and what was found.
    """
    labelled = judged.where((F.col("lang_pred") != UNKNOWN) & F.col("lang").isNotNull())
    least = labelled.groupBy("lang_pred", _size(F.col("text")).alias("size")).agg(F.min("lang_cosine").alias("least"))
    return least.groupBy("lang_pred").agg(F.collect_list(F.struct("size", "least")).alias("_floor"))  # 31 sizes at most


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs (with text and lang) whose language can be told, by profiles of all labelled rows.

    A size's floor is the least of its own and all larger sizes; sizes above the largest take its floor.
    """
    prototypes = learn_languages(docs.select("text", "lang"))
    if prototypes.isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = staged(identify_language(docs, prototypes), "judged")
    least = staged(floors(judged), "floors")
    least = F.broadcast(least) if least.count() <= MOST_SENT else least
    of = lambda c: F.transform("_floor", lambda x: x[c])
    size = F.least(_size(F.col("text")), F.array_max(of("size")))
    floor = F.array_min(F.transform(F.filter("_floor", lambda x: x["size"] >= size), lambda x: x["least"]))
    passed = (F.col("lang_cosine") >= floor) | (size < F.array_min(of("size")))
    both = judged.where(F.col("lang_pred") != UNKNOWN).join(least, "lang_pred", "left")
    return both.where(F.col("_floor").isNull() | passed).select(*docs.columns)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = learn_languages(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    judged = identify_language(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), prototypes)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "lang_cosine")
