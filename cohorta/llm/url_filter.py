"""URL filters: fixed rules, and association rules that Spark's FP-growth mines from labels.

The fixed rules label the pages they fit. FP-growth mines the combinations of URL tokens and
labels that are frequent among labelled pages; rules "tokens -> label" of enough support and
confidence judge the other pages. A rule is pruned if a rule with fewer of its tokens says
the same with no less confidence. Rules are found by an inverted index: each stands
under its rarest token.

* Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
  then up to ``?``, ``#`` or the end. Null, or without ``://``: both empty, and no token.
* Tokens of a URL: its host, the host's last label, each of its endings of two labels or more, every
  path part with its place (digits as 0) and every key of the query.
* A fixed rule fits its host and all subdomains if the path starts with the rule's path; the
  longest (host and path together) wins.
* Of the mined rules that match, the most confident wins, then the best supported, then
  the one with more tokens, then block. Where none matches, the verdict is ``DEFAULT``.
* Repeated pages count as often as they occur; without labelled pages nothing is mined.
* Input columns are kept; a result column takes the place of an input column of its name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import bounded_batches, discard, lean, staged

#: Verdict, host and path of each rule.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SUPPORT, CONFIDENCE = 0.01, 0.7
DEFAULT = "allow"
#: Most mined rules in one broadcast; more are sent in several passes.
BLOCK_RULES = 50_000
_LABELS = {"allow": "=allow", "block": "=block"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest fixed rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    tests = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered]
    return F.coalesce(*tests)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host, its last label, its last two labels and up, all path parts by place, all keys of the query."""
    part = lambda s: F.regexp_replace(s, "[0-9]+", "0")
    labels = F.split(host, r"\.")
    domain = lambda i: F.concat(F.lit("domain "), F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pieces = F.filter(F.split(path, "/"), lambda s: s != "")
    asked = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)  # what follows a # is no query
    keys = F.filter(F.split(asked, "&"), lambda s: s != "")
    return F.array_distinct(F.concat(
        F.when(host == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("host "), host), F.concat(F.lit("top "), F.element_at(labels, -1)))),
        F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), domain)).otherwise(F.array().cast("array<string>")),
        F.transform(pieces, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit(" "), part(s))),
        F.transform(keys, lambda s: F.concat(F.lit("key "), F.element_at(F.split(s, "="), 1))),
    ))


def mine(labelled: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, verdict, confidence, support) from rows of ``tokens`` and ``verdict``."""
    spark = labelled.sparkSession
    schema = "tokens array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return spark.createDataFrame([], schema)
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    ours = found.where(F.col("consequent")[0].isin(*_LABELS.values())).where(~F.arrays_overlap("antecedent", F.lit(list(_LABELS.values()))))
    rules = staged(ours.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), "confidence", "support"), "rules")
    # A rule goes if dropping one token gives a rule at least as confident of the same verdict.
    shorter = rules.select("verdict", F.col("tokens").alias("whole"), "confidence", F.explode("tokens").alias("t")).select("verdict", "whole", "confidence", F.array_remove("whole", F.col("t")).alias("tokens"))
    better = shorter.join(rules.withColumnRenamed("confidence", "c"), ["verdict", "tokens"]).where("c >= confidence").select("verdict", F.col("whole").alias("tokens")).distinct()
    return rules.join(better, ["verdict", "tokens"], "left_anti").select("tokens", "verdict", "confidence", "support")


class RuleIndex:
    def __init__(self, rules: list[tuple[list[str], str, float, float]]):
        often: dict[str, int] = {}
        for t, *_ in rules:
            for x in t:
                often[x] = often.get(x, 0) + 1
        self.under: dict[str, list] = {}
        for t, verdict, confidence, support in rules:
            rarest = min(t, key=lambda x: (often[x], x))
            self.under.setdefault(rarest, []).append(((confidence, support, len(t), verdict), frozenset(t)))

    def best(self, found: list[str]) -> tuple | None:
        own = set(found)
        return max((rank for x in own for rank, t in self.under.get(x, ()) if t <= own), default=None)


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds mined: (confidence, support, n_tokens, verdict) of the best mined rule, or null."""
    kind = "struct<confidence:double,support:double,n_tokens:int,verdict:string>"
    pages = pages.drop(*[c for c in pages.columns if c.lower() == "mined"])
    bounded_batches(pages.sparkSession)
    out = pages.withColumn("mined", F.lit(None).cast(kind))
    blocks = max(1, -(-rules.count() // BLOCK_RULES))
    for k in range(blocks):
        part = [tuple(r) for r in rules.where(F.pmod(F.xxhash64("tokens", "verdict"), F.lit(blocks)) == k).collect()]
        sent = pages.sparkSession.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            index = RuleIndex(sent.value)
            for batch in batches:
                at = batch.schema.get_field_index("mined")
                memo: dict[tuple, tuple | None] = {}
                best = []
                for found, old in zip(batch.column("tokens").to_pylist(), batch.column(at).to_pylist()):
                    key = tuple(found or ())
                    if key not in memo:
                        memo[key] = index.best(list(key))
                    new, old = memo[key], tuple(old.values()) if old else None
                    best.append(max((x for x in (new, old) if x), default=None))
                rows = [dict(zip(("confidence", "support", "n_tokens", "verdict"), x)) if x else None for x in best]
                kept = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
                yield pa.RecordBatch.from_pydict(kept | {"mined": pa.array(rows, batch.schema.field(at).type)})

        before, out = out, out.mapInArrow(lean(run), out.schema)
        if k < blocks - 1:  # one pass, with one block, is alive at a time
            out = staged(out, "matched")
            if k:
                discard(before)
    return out


def judge(pages: DataFrame, *, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Each page with host, path, rule, verdict and mined."""
    own = {"host", "path", "rule", "verdict", "tokens", "fits", "mined"}
    pages = pages.drop(*[c for c in pages.columns if c.lower() in own])
    host, path = host_and_path(F.col("url"))
    read = pages.withColumn("host", host).withColumn("path", path)
    read = read.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")))
    labelled = read.where("fits is not null").select("tokens", F.col("fits.verdict").alias("verdict"))
    mined = staged(mine(labelled, support=support, confidence=confidence), "mined")
    out = match(read, mined)
    return out.withColumn("rule", F.col("fits.rule")).withColumn("verdict", F.coalesce("fits.verdict", "mined.verdict", F.lit(DEFAULT))).drop("fits", "tokens")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
