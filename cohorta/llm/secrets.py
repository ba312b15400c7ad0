"""Secret scans: known patterns, and strings that look random rather than written.

Two character Markov models, one of random strings and one of ordinary identifiers, are trained
on labelled samples of all documents: the values that the patterns find are random, every
other token (a run of characters that a secret can hold) is an ordinary word or identifier.
What lies between tokens, and the borders of texts, belong to neither. A token's
log-likelihood ratio under the two decides.

* Base kinds: assign, access, hex (see the patterns); a match that is too short is dropped
  but still uses up its characters. Added kind: markov, for tokens of any length that do
  not lie wholly inside base spans and whose ratio is at least ``BITS`` in all and ``BITS_EACH``
  a character.
* Spans count code points, end exclusive. Null and empty texts have none.
* Without any base match there is no model of random strings and nothing is added.
* Repeated rows count as often as they occur; ties in start follow the order of kinds.
* Input columns are kept; a result column takes the place of an input column of its name.

Training sends two tables of ``SYMBOLS`` squared counts a task; Spark sums them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import bounded_batches, lean, slices, text_bytes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BITS, BITS_EACH = 30.0, 1.5
KINDS = ("assign", "access", "hex", "markov")
#: Characters a token can hold, and one symbol for all others (that ends a token).
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(_CHARS) + 1
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[np.frombuffer(_CHARS.encode(), np.uint8)] = np.arange(1, SYMBOLS)
_KEYWORDS = ("passw", "secret", "token", "key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order of start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _value(text: str, kind: int, start: int, end: int) -> str:
    return ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]


def _values(text: str) -> list[str]:
    """The secrets that the patterns find; one that lies within another, or overlaps it, is no second one."""
    out, last = [], 0
    found = [(b - len(_value(text, k, a, b)), b) for a, k, b in base_spans(text)]
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if end > last:
            out.append(text[max(start, last) : end])
            last = end
    return out


def _pairs(raw: bytes) -> np.ndarray:
    """How often each pair of symbols stands in the tokens, their first and last character paired with the end of a token."""
    s = _SYMBOL[np.frombuffer(b" " + raw + b" ", np.uint8)]
    out = np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=SYMBOLS * SYMBOLS).astype(np.int64)
    out[0] = 0  # no token on either side
    return out


def train(docs: DataFrame) -> np.ndarray | None:
    """log2 of the two models' ratio for each pair of symbols; None without random strings."""

    def count(batches):
        whole, random = np.zeros(SYMBOLS * SYMBOLS, np.int64), np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                raw, start, end = text_bytes(part.column(0))
                raw = raw.tobytes()
                whole += _pairs(b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist())]))
                values = [v for t in part.column(0).to_pylist() if t for v in _values(t)]
                if values:
                    random += _pairs(" ".join(values).encode())
        at = np.flatnonzero(whole + random)
        yield pa.RecordBatch.from_pydict({"pair": at.astype(np.int32), "whole": whole[at], "random": random[at]})

    bounded_batches(docs.sparkSession)
    sums = docs.select("text").mapInArrow(lean(count), "pair int, whole long, random long").groupBy("pair").agg(F.sum("whole").alias("whole"), F.sum("random").alias("random"))
    whole, random = np.zeros(SYMBOLS * SYMBOLS), np.zeros(SYMBOLS * SYMBOLS)
    for r in sums.collect():  # SYMBOLS squared rows at most
        whole[r["pair"]], random[r["pair"]] = r["whole"], r["random"]
    if not random.sum():
        return None
    ordinary = np.maximum(whole - random, 0).reshape(SYMBOLS, SYMBOLS)
    random = random.reshape(SYMBOLS, SYMBOLS)
    # The random model backs off to its characters' own frequencies, which few samples suffice for.
    own = random.sum(axis=0) + 1.0
    own = own / own.sum()
    p = (random + 200 * own) / (random.sum(axis=1, keepdims=True) + 200)
    q = (ordinary + 0.5) / (ordinary.sum(axis=1, keepdims=True) + 0.5 * SYMBOLS)
    return np.log2(p / q)


def added_spans(text: str, ratio: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    s = _SYMBOL[np.minimum(np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32), 255)]
    edge = np.flatnonzero((s[1:] > 0) != (s[:-1] > 0))
    first, last = edge[::2] + 1, edge[1::2]  # of each token, the blank in front counted
    bits = np.concatenate(([0.0], np.cumsum(ratio[s[:-1], s[1:]])))
    total = bits[last] - bits[first]  # the pairs within the token
    ok = (total >= BITS) & (total >= BITS_EACH * (last - first))
    found = [(a - 1, 3, b) for a, b in zip(first[ok].tolist(), last[ok].tolist())]
    return [t for t in found if not _inside(t[0], t[2], base)]


def _inside(start: int, end: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether the spans, in order of start, cover all from start to end."""
    for a, _, b in base:
        if a <= start < b:
            start = b
    return start >= end


def scan_secrets(docs: DataFrame, ratio: np.ndarray | None) -> DataFrame:
    """Adds secrets: an array of (kind, start, end) in order of start, then kind."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "secrets"])
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches):
        table = sent.value
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                spans = base_spans(t) if t else []
                if t and table is not None:
                    spans = sorted(spans + added_spans(t, table, spans))
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            kept = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            yield pa.RecordBatch.from_pydict(kept | {"secrets": pa.array(rows, kind)})

    schema = docs.withColumn("secrets", F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")).schema
    return docs.mapInArrow(lean(scan), schema)


def mask_secrets(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Replaces each run of overlapping spans in text by ``mark``; null stays null."""

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        out = []
        for t, rows in zip(text, spans):
            if t is not None and rows is not None and len(rows):
                runs: list[list[int]] = []
                for r in rows:
                    if runs and r["start"] < runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], r["end"])
                    else:
                        runs.append([r["start"], r["end"]])
                for a, b in reversed(runs):
                    t = t[:a] + mark + t[b:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return scanned.withColumn("text", F.when(F.size("secrets") > 0, cut("text", "secrets")).otherwise(F.col("text")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, train(docs)).drop("text")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *map(number, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
