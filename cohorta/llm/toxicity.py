"""Toxicity by maximum-scoring segments of token log-odds.

1. Of each word and each prefix of ``PREFIX`` letters, the toxic and the clean training
   documents that have it are counted. Its score is the log-odds under a Dirichlet prior in
   proportion to the corpus, drawn towards 0 by ``Z`` standard errors and a margin. Positive
   ones are what is left after the classes' own odds: such a word alone makes label 1 the
   likelier. Negative ones stay negative. A word has the larger of its own and its prefix's
   score, 0 if neither is known, and every word costs ``STEP`` besides.
2. A linear-time scan finds all maximal-scoring segments of a text (Ruzzo and Tompa).
3. Extreme-value calibration: the number of segments of clean text that reach s in n words is
   expected to be K n exp(-lambda s). lambda is the positive root of E[exp(lambda s)] = 1 over the
   word scores of all clean training texts; K has the greatest likelihood, given their largest segments.
   A segment is a significant passage if that number is at most ``SIGNIFICANT``. A text's
   statistic adds, over its segments, how far below one the number is; a logistic curve
   makes it a probability.

* Training takes labelled documents only; exact copies with the same label count once.
* Null, empty and wordless texts have no segment and get the score of a text without one.
* Without toxic or without clean training texts every score is the share of toxic ones (0
  without labels). Labels other than 0 and 1 and rows without an id or label teach nothing.
* Ties between segments do not arise: all are used. Repeated label rows count once.
* The logistic curve is fitted on at most ``FIT_ROWS`` training texts, those of least hash;
  counts and the extreme-value law use all of them.
* Input columns are kept; a result column takes the place of an input column of its name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import IdFilter, bounded_batches, discard, fold, lean, staged
from cohorta.llm.decontaminate import _WORD_BYTE

PREFIX = 4
PRIOR_SHARE, Z, MARGIN, STEP = 0.1, 1.64, 0.3, 0.02
#: Most labelled texts that the logistic curve is fitted on.
FIT_ROWS = 50_000
#: About the most tokens of the lexicon in one broadcast; more are sent in several passes.
BLOCK_TOKENS = 200_000
#: Most segments of clean text expected to score as much as a passage that is reported.
SIGNIFICANT = 0.05
THRESHOLD = 0.3
#: Scores fall in bins of this width when their distribution is counted.
_BIN = 0.01


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_WORD_BYTE).split() if text else []


def prefix_of(word: bytes) -> bytes | None:
    w = word.decode()
    return b"^" + w[:PREFIX].encode() if len(w) > PREFIX else None


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) in linear time."""
    found: list[list] = []  # left sum, right sum, start, end, and the nearest one before with a smaller left sum
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [before, total, i, i + 1, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j = found[j][4]
            if j < 0 or found[j][1] >= new[1]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(x[1] - x[0], x[2], x[3]) for x in found]


class _Scores(dict):
    """A word's score in a block of the lexicon, NaN if it has none there, worked out once."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > 200_000:
            self.clear()
        p = prefix_of(word)
        known = [x for x in (self.lexicon.get(word), self.lexicon.get(p) if p else None) if x is not None]
        s = self[word] = max(known) if known else math.nan
        return s


@dataclass
class Model:
    lexicon: DataFrame | None
    base_rate: float = 0.0
    rate: float = 0.0
    decay: float = 1.0
    weights: tuple[float, float] = (0.0, 0.0)

    def excess(self, score: Column, n_words: Column) -> Column:
        """How far, as a logarithm, the expected number of such segments in clean text is below one; 0 if it is not."""
        return F.greatest(F.lit(0.0), self.decay * score - F.log(F.greatest(F.lit(self.rate) * n_words, F.lit(1e-300))))

    def statistic(self, passages: str, n_words: str) -> Column:
        return F.aggregate(passages, F.lit(0.0), lambda t, p: t + self.excess(p["score"], F.col(n_words)))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents, one of each group of exact copies of a label."""
    label = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    one = staged(keyed.join(label, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct(), "labelled")
    rows = IdFilter(one).maybe(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", True)
    return rows.join(one.hint("merge"), "doc_id")  # labels grow with the corpus: never broadcast them


def _count_tokens(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean): how many documents of either kind have it."""

    def run(batches):
        count: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(words_of(text))
                for t in words | {p for w in words if (p := prefix_of(w))}:
                    count.setdefault(t, [0, 0])[toxic] += 1
                if len(count) > 300_000:
                    yield out(count)
                    count = {}
        if count:
            yield out(count)

    def out(count):
        both = np.array(list(count.values()), np.int64)
        return pa.RecordBatch.from_pydict({"token": pa.array(list(count), pa.binary()), "toxic": both[:, 1], "clean": both[:, 0]})

    return rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "token binary, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    a, b = F.col("toxic"), F.col("clean")
    prior = PRIOR_SHARE * (a + b)
    ya, yb = a + prior, b + prior
    classes = math.log(n_clean / n_toxic)
    odds, slack = F.log(ya / yb) + classes, Z * F.sqrt(1 / ya + 1 / yb) + MARGIN
    score = F.greatest(odds - slack - classes, F.lit(0.0)) + F.least(odds + slack, F.lit(0.0))  # one of the two is 0 at least
    return counts.select("token", score.alias("score")).where("score != 0")


_PASSAGES = "array<struct<score:double,start:int,end:int>>"


def _passages(docs: DataFrame, lexicon: DataFrame, tally: bool = False) -> DataFrame:
    """Adds n_words and passages: the maximal segments as (score, first word, end).

    tally: adds instead n_words, passages and bins, how many words scored what in hundredths.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"n_words", "passages", "word_scores", "bins"}])
    blocks = max(1, math.ceil(lexicon.count() / BLOCK_TOKENS))
    passage = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    out = docs.withColumn("word_scores", F.lit(None).cast("array<double>"))
    schema = out.schema
    final = docs.withColumn("n_words", F.lit(None).cast("long")).withColumn("passages", F.lit(None).cast(_PASSAGES))
    final = (final.withColumn("bins", F.lit(None).cast("map<int,long>")) if tally else final).schema
    for k in range(blocks):
        part = lexicon.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == k).collect()  # BLOCK_TOKENS rows or so
        sent = spark.sparkContext.broadcast({bytes(r["token"]): r["score"] for r in part})
        last = k == blocks - 1

        def run(batches, sent=sent, last=last):
            memo = _Scores(sent.value)
            for batch in batches:
                at = batch.schema.get_field_index("word_scores")
                n, rows, bins = [], [], []
                for text, old in zip(batch.column("text").to_pylist(), batch.column(at)):
                    words = words_of(text)
                    n.append(len(words))
                    s = np.array([memo[w] for w in words])
                    if old.is_valid:
                        s = np.fmax(s, np.asarray(old.values, np.float64))
                    if not last:
                        rows.append(s)
                        continue
                    s = np.nan_to_num(s) - STEP
                    rows.append([{"score": x, "start": a, "end": b} for x, a, b in segments(s.tolist())] if (s > 0).any() else [])
                    if tally:
                        bins.append(list(zip(*(x.tolist() for x in np.unique(np.rint(s / _BIN).astype(np.int32), return_counts=True)))))
                kept = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if i != at}
                if last:
                    more = {"bins": pa.array(bins, pa.map_(pa.int32(), pa.int64()))} if tally else {}
                    yield pa.RecordBatch.from_pydict(kept | {"n_words": pa.array(n, pa.int64()), "passages": pa.array(rows, passage)} | more)
                else:
                    yield pa.RecordBatch.from_pydict(kept | {"word_scores": pa.array(rows, pa.list_(pa.float64()))})

        before, out = out, out.mapInArrow(lean(run), final if last else schema)
        if not last:  # one pass, with one block, is alive at a time
            out = staged(out, "scored")
            if k:
                discard(before)
    return out


def decay_of(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1; scores must have a negative mean and a positive value."""
    share, low, high = counts / counts.sum(), 0.0, 1.0
    over = lambda x: float(np.sum(share * np.exp(np.minimum(x * scores, 700.0)))) > 1
    while not over(high):
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle) else (middle, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope with a slight ridge, by Newton's method."""
    scale = max(float(x.std()), 1e-9)
    a = np.stack((np.ones(len(x)), x / scale), axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 0.05])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([0, 0.05]) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0) / scale)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = staged(training_rows(docs, labels), "training")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(None, n_toxic / max(1, n_toxic + n_clean))
    lexicon = staged(_lexicon(_count_tokens(rows), n_toxic, n_clean), "lexicon")
    found = staged(_passages(rows, lexicon, True).select("doc_id", "toxic", "n_words", "passages", "bins"), "passages")
    clean = found.where("toxic = 0")
    bins = clean.select(F.explode("bins").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # the width of the scores over _BIN rows
    scores, counts = np.asarray(bins.column("bin")) * _BIN, np.asarray(bins.column("n")).astype(float)
    # Half a word of unit score, and of cost 1, keep the root finite where clean texts have no positive word, and positive.
    scores, counts = np.append(scores, [1.0, -1.0]), np.append(counts, [0.5, 0.5])
    decay = decay_of(scores, counts) if scores @ counts < 0 else 1e-3
    # n K exp(-lambda m) of a text's largest segment m is exponential with mean one.
    largest = F.coalesce(F.array_max(F.transform("passages", lambda p: p["score"])), F.lit(0.0))
    fit = clean.where("n_words > 0").agg(F.count("*").alias("n"), F.sum(F.col("n_words") * F.exp(-decay * largest)).alias("total")).first()
    model = Model(lexicon, n_toxic / (n_toxic + n_clean), (fit["n"] or 1) / max(fit["total"] or 1.0, 1e-300), decay)
    sample = found.orderBy(F.xxhash64("doc_id")).limit(FIT_ROWS).select(F.col("toxic").cast("double"), model.statistic("passages", "n_words").alias("x")).toArrow()  # two numbers a row
    model.weights = _logistic(np.asarray(sample.column("x")), np.asarray(sample.column("toxic")))
    discard(found)
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Adds n_words, passages (the significant ones: score, first word, end) and score, the probability of label 1."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "score"])
    if model.lexicon is None:
        none = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("passages", F.array().cast(_PASSAGES))
        return none.withColumn("score", F.lit(float(model.base_rate)))
    curve = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.weights[0] + model.weights[1] * model.statistic("passages", "n_words")))
    scored = _passages(docs, model.lexicon).withColumn("score", 1 / (1 + F.exp(-curve)))
    return scored.withColumn("passages", F.filter("passages", lambda p: model.excess(p["score"], F.col("n_words")) >= -math.log(SIGNIFICANT)))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
