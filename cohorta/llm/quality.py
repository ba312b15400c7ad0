"""Quality rules by line: a linear-chain conditional random field marks content and boilerplate.

A text's lines with a visible character are a chain of two labels. Each line has a few traits (how
many symbols, capitals, digits and bars its words have, how it ends, how long it is, whether it or
its three-word windows repeat, where it stands); a trait's level has a weight, and so has each pair of neighbouring
labels. The weights are those of greatest likelihood on labelled texts; Viterbi decoding gives the
likeliest labels of a text, and it is kept if at least ``SHARE`` of its words are in content lines.

* Words: ``[^\\x20\\x09-\\x0D]+``; lines end at ``\\n``. Null and empty texts have no words and no lines.
* Labels say of whole texts whether they are good. At first all lines of a text get its label; then
  lines of bad texts that look like content by themselves, as those of good texts do, become content.
* Without labelled texts, or if they are all good or all bad, every line is content.
* A null doc_id is judged like any other; repeated labels count as often as they occur. Ties between
  paths go to content.
* Input columns are kept; a result column takes the place of an input column of its name.

The field is fitted on the driver on at most ``FIT_ROWS`` labelled texts, those of least hash, and of
each at most ``FIT_LINES`` lines, evenly spread pieces of ``FIT_PIECE`` lines. Everything else covers whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta.llm.common import bounded_batches, lean, slices, text_bytes

FIT_ROWS, FIT_LINES, FIT_PIECE, FIT_STEPS = 4000, 64, 16, 150
#: Of a text's words, the part in content lines from which it is kept.
SHARE = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_CHARS = (np.arange(256) & 0xC0) != 0x80
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Traits that are shares: which bytes count, over words or characters, and the bounds of their levels.
_SHARES = (
    (_SYMBOLS, "words", (1e-9, 0.05, 0.25, 0.6)),
    (np.isin(np.arange(256), np.frombuffer(b"|", np.uint8)), "words", (1e-9, 0.25)),
    (np.isin(np.arange(256), np.frombuffer(b"!", np.uint8)), "words", (1e-9, 0.2, 0.6)),
    ((np.arange(256) >= 65) & (np.arange(256) <= 90), "chars", (1e-9, 0.08, 0.3, 0.6)),
    ((np.arange(256) >= 48) & (np.arange(256) <= 57), "chars", (1e-9, 0.05, 0.25)),
    (np.isin(np.arange(256), np.frombuffer(b"{}[]()=_\\/@~^", np.uint8)), "words", (1e-9, 0.1, 0.5)),
)
_WORDS, _LENGTH, _REPEATED = (3, 8, 20, 60), (2.5, 4, 6, 9, 14), (0.02, 0.2, 0.5)
#: Levels of each trait, in order: the shares, words, letters a word, repeated words, copy of a line, how it ends, place.
LEVELS = [*(len(b) + 1 for _, _, b in _SHARES), len(_WORDS) + 1, len(_LENGTH) + 1, len(_REPEATED) + 1, 2, 3, 4]
FIRST = np.cumsum([0, *LEVELS])
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> np.ndarray:
    """Which words stand in a three-word window that the text holds twice or more."""
    mask = np.zeros(len(words), bool)
    if len(words) < 4:
        return mask
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = x[:-2] * len(number) + x[1:-1]
    if len(number) ** 3 >= 1 << 62:
        key = np.unique(key, return_inverse=True)[1]
    key = key * len(number) + x[2:]
    inorder = np.sort(key)
    twice = inorder[1:][inorder[1:] == inorder[:-1]]
    if len(twice):
        again = np.flatnonzero(np.isin(key, twice))
        for j in range(3):
            mask[again + j] = True
    return mask


class Lines:
    """The lines with a word of some texts: traits as weight numbers (a row a line), words, and each text's base figures."""

    def __init__(self, column):
        raw, start, end = text_bytes(column)
        word = ~_SPACE[raw]
        begins = word & np.concatenate(([True], ~word[:-1])) if len(raw) else word
        if len(raw):
            begins[start[(start < len(raw)) & (end > start)]] = word[start[(start < len(raw)) & (end > start)]]
        total = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        words, chars, symbols = total(begins), total(word & _CHARS[raw]), total(_SYMBOLS[raw])
        self.base = {"n_words": words[end] - words[start], "word_chars": chars[end] - chars[start], "n_symbols": symbols[end] - symbols[start]}
        text = raw.tobytes()
        first, last, copy, repeated, dup, rep, sizes = [], [], [], [], [], [], []
        for a, b in zip(start.tolist(), end.tolist()):
            mask = repeated_words(text[a:b].split())
            many = np.concatenate(([0], np.cumsum(mask)))
            seen: set[bytes] = set()
            n, at = 0, a
            dups = 0
            for line in text[a:b].split(b"\n") if b > a else ():
                if not line.isspace() and line:
                    again = line in seen
                    seen.add(line)
                    dups += again
                    low, high = words[at] - words[a], words[at + len(line)] - words[a]
                    first.append(at)
                    last.append(at + len(line))
                    copy.append(again)
                    repeated.append((many[high] - many[low]) / max(high - low, 1))
                    n += 1
                at += len(line) + 1
            sizes.append(n)
            dup.append(dups)
            rep.append(int(many[-1]))
        self.base |= {"n_dup_lines": np.array(dup, np.int64), "n_repeat_words": np.array(rep, np.int64)}
        self.sizes = np.array(sizes, np.int64)
        first, last = np.array(first, np.int64), np.array(last, np.int64)
        self.words = words[last] - words[first]
        letters = chars[last] - chars[first]
        over = {"words": np.maximum(self.words, 1), "chars": np.maximum(letters, 1)}
        level = [np.searchsorted(bounds, (t[last] - t[first]) / over[of], "right") for cls, of, bounds in _SHARES for t in [total(cls[raw])]]
        level += [np.searchsorted(_WORDS, self.words, "right"), np.searchsorted(_LENGTH, letters / over["words"], "right"), np.searchsorted(_REPEATED, np.array(repeated), "right"), np.array(copy, np.int64)]
        ends = [text[a:b].rstrip()[-1:] for a, b in zip(first.tolist(), last.tolist())]
        level.append(np.array([0 if e in b".!?\"'" else 1 if e in b",;:" else 2 for e in ends], np.int64))
        at = np.cumsum(self.sizes) - self.sizes
        place = np.ones(len(first), np.int64)
        place[(at + self.sizes - 1)[self.sizes > 0]] = 2
        place[at[self.sizes > 0]] = 0
        place[at[self.sizes == 1]] = 3
        level.append(place)
        self.traits = np.stack([x + f for x, f in zip(level, FIRST)], axis=1).astype(np.int16) if len(first) else np.zeros((0, len(LEVELS)), np.int16)


class Field:
    """Weights of content over boilerplate: one for each level of a trait, and of each pair of labels (boilerplate 0, content 1)."""

    def __init__(self, weights: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.weights = np.zeros(FIRST[-1]) if weights is None else weights
        self.pairs = np.zeros((2, 2)) if pairs is None else pairs

    def labels(self, traits: np.ndarray) -> np.ndarray:
        """The likeliest labels of one text's lines, by Viterbi."""
        score = self.weights[traits].sum(axis=1).tolist()
        (t00, t01), (t10, t11) = self.pairs.tolist()
        back, zero, one = [], 0.0, 0.0
        for k, s in enumerate(score):
            if k:
                from0, from1 = one + t10 >= zero + t00, one + t11 >= zero + t01
                zero, one = (one + t10 if from0 else zero + t00), (one + t11 if from1 else zero + t01) + s
                back.append((from0, from1))
            else:
                one = s
        out = np.zeros(len(score), bool)
        at = one >= zero
        for k in range(len(score) - 1, -1, -1):
            out[k] = at
            if k:
                at = back[k - 1][at]
        return out

    def fit(self, traits: np.ndarray, labels: np.ndarray, sizes: np.ndarray, chain: bool) -> Field:
        """Maximum likelihood with a small quadratic penalty, by gradient steps with momentum scaled by curvature bounds."""
        first = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        first, sizes = first[order], sizes[order]
        alive = [int((sizes > k).sum()) for k in range(int(sizes.max(initial=0)))]
        inner = np.ones(len(labels), bool)
        inner[first] = False
        seen_pairs = np.bincount((labels[:-1] * 2 + labels[1:])[inner[1:]], minlength=4).reshape(2, 2).astype(float)
        seen = np.bincount(traits.ravel(), weights=np.repeat(labels, traits.shape[1]), minlength=FIRST[-1])
        m1, m2, n = np.zeros(FIRST[-1] + 4), np.zeros(FIRST[-1] + 4), len(labels)
        w, t = self.weights.copy(), self.pairs.copy()
        for step in range(1, FIT_STEPS + 1):
            score = w[traits].sum(axis=1)
            one, pairs = self._marginals(score, t, first, alive) if chain else (1 / (1 + np.exp(-score)), seen_pairs)
            expected = np.bincount(traits.ravel(), weights=np.repeat(one, traits.shape[1]), minlength=FIRST[-1])
            g = np.concatenate(((seen - expected) / n - 1e-4 * w, ((seen_pairs - pairs) / n - 1e-4 * t).ravel() * chain))
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            move = 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            w, t = w + move[:-4], t + move[-4:].reshape(2, 2)
        return Field(w, t)

    @staticmethod
    def _marginals(score: np.ndarray, t: np.ndarray, first: np.ndarray, alive: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of content, and the expected number of each pair of labels; chains side by side, longest first."""
        up, down, pairs = np.zeros((len(score), 2)), np.zeros((len(score), 2)), np.zeros((2, 2))
        for k, n in enumerate(alive):
            at = first[:n] + k
            up[at, 1] = score[at]
            if k:
                up[at] += np.logaddexp(up[at - 1, 0, None] + t[0], up[at - 1, 1, None] + t[1])
        for k in range(len(alive) - 2, -1, -1):
            at = first[: alive[k + 1]] + k
            after = down[at + 1] + np.stack((np.zeros(len(at)), score[at + 1]), axis=1)
            down[at] = np.logaddexp(after[:, 0, None] + t[:, 0], after[:, 1, None] + t[:, 1])
            both = up[at][:, :, None] + t + after[:, None, :]
            pairs += np.exp(both - np.logaddexp.reduce(both.reshape(len(at), 4), axis=1)[:, None, None]).sum(axis=0)
        total = up + down
        return 1 / (1 + np.exp(total[:, 0] - total[:, 1])), pairs


def learn_field(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field of labelled texts: docs (doc_id, text), labels (doc_id, quality: 1 good, 0 bad); None if they can't teach it."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(FIT_ROWS))
    bounded_batches(docs.sparkSession)

    def traits(batches):
        for batch in batches:
            for part in slices(batch, 1 << 20):
                lines = Lines(part.column(0))
                quality, at, rows, good = part.column(1).to_pylist(), 0, [], []
                for q, n in zip(quality, lines.sizes.tolist()):
                    own = lines.traits[at : at + n]
                    pieces = -(-n // FIT_PIECE)
                    for k in sorted({int(j) for j in np.linspace(0, pieces - 1, min(pieces, FIT_LINES // FIT_PIECE))}) if n else ():
                        rows.append(own[k * FIT_PIECE : (k + 1) * FIT_PIECE].ravel().tolist())
                        good.append(q)
                    at += n
                yield pa.RecordBatch.from_pydict({"traits": pa.array(rows, pa.list_(pa.int16())), "good": pa.array(good, pa.int32())})

    most = FIT_ROWS * (FIT_LINES // FIT_PIECE)
    found = docs.select("doc_id", "text").where("text is not null").join(some, "doc_id").select("text", "quality").mapInArrow(lean(traits), "traits array<smallint>, good int")
    some = found.orderBy(F.xxhash64("traits"), "traits", "good").limit(most)  # more only if rows share an id
    pieces = sorted((r["good"], list(r["traits"])) for r in some.collect())
    if len({g for g, _ in pieces}) < 2:
        return None
    sizes = np.array([len(x) // len(LEVELS) for _, x in pieces], np.int64)
    traits_ = np.array([v for _, x in pieces for v in x], np.int64).reshape(-1, len(LEVELS))
    good = np.repeat(np.array([g for g, _ in pieces], np.int64), sizes)
    alone = Field().fit(traits_, good, sizes, chain=False)
    for _ in range(2):
        line = np.where(good == 1, 1, (alone.weights[traits_].sum(axis=1) > 0).astype(np.int64))
        alone = alone.fit(traits_, line, sizes, chain=False)
    if line.all():
        return None
    return Field(alone.weights).fit(traits_, line, sizes, chain=True)


def mark_lines(docs: DataFrame, field: Field | None) -> DataFrame:
    """Adds the base figures (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), ``content`` (of each line with a word,
    whether it is content) and ``content_words``, the words of content lines."""
    added = T.StructType([T.StructField(c, T.LongType()) for c in BASE]).add("content", T.ArrayType(T.BooleanType())).add("content_words", "long")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added.names])
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def mark(batches):
        field = sent.value
        for batch in batches:
            for part in slices(batch, 2 << 20):
                lines, at, content, inside = Lines(part.column("text")), 0, [], []
                for n in lines.sizes.tolist():
                    label = np.ones(n, bool) if field is None else field.labels(lines.traits[at : at + n])
                    content.append(label)
                    inside.append(int(lines.words[at : at + n][label].sum()))
                    at += n
                ends = np.concatenate(([0], np.cumsum(lines.sizes))).astype(np.int32)
                flat = np.concatenate(content) if content else np.zeros(0, bool)
                kept = {f.name: part.column(i) for i, f in enumerate(part.schema)}
                kept |= {c: pa.array(lines.base[c], pa.int64()) for c in BASE}
                yield pa.RecordBatch.from_pydict(kept | {"content": pa.ListArray.from_arrays(ends, pa.array(flat, pa.bool_())), "content_words": pa.array(inside, pa.int64())})

    return docs.mapInArrow(lean(mark), T.StructType([*docs.schema.fields, *added.fields]))


def judged(marked: DataFrame) -> DataFrame:
    """Adds base_failed (too few words, or too many repeated) and kept: not that, and enough words in content lines."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return marked.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_words") >= F.lit(SHARE) * F.col("n_words")))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = judged(mark_lines(docs.select("doc_id", "text"), learn_field(docs, labels)))
    return found.select("doc_id", *BASE, "base_failed", "kept", "content_words", F.size("content").cast("long").alias("n_lines"))


def brute_base(text: str | None) -> tuple[int, int, int, int, int]:
    """The base figures of one text, spelled out."""
    import re
    from collections import Counter

    text = text or ""
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    words, lines = find(text), [x for x in text.split("\n") if find(x)]
    windows = list(zip(words, words[1:], words[2:]))
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(i, i + 3))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)
