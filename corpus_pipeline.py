"""From raw documents to packed training sequences, in stages that each reread the last one's rows.

Every stage but the last returns the columns of ``documents``; rows that a stage keeps are
whole rows, except that masked secrets change ``text`` and, with it, ``n_chars``.

For every stage: an empty table gives an empty one, further columns are carried along whatever
their names, and rows with a null ``doc_id`` are judged by their texts like any other. What
each does with null and empty texts, repeated rows and ties stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import staged
from cohorta.llm.decontaminate import decontaminate, remove_documents
from cohorta.llm.language import known_language
from cohorta.llm.near_dedup import near_duplicates
from cohorta.llm.packing import pack
from cohorta.llm.secrets import mask_secrets, scan_secrets, train

#: Least similarity of near copies in the pipeline; op4's own threshold is 85.
NEAR_HUNDREDTHS = 80
#: No SQL: the stages learn models and compare signatures. Tests hold each against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: no letter, or unlike all languages learnt from the labelled rows.

    So null and empty texts go. Repeated rows share their fate and count as often as they occur in
    learning; ties between languages go to the one that sorts first. Without labels every text
    with a letter stays.
    """
    return known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8 or more) the document of smallest id stays.

    Texts that are null or without words are in no group and stay. Rows that share an id are one
    document: all of them stay or go. Rows without an id stay.
    """
    gone = staged(near_duplicates(docs, hundredths=NEAR_HUNDREDTHS).where("not kept").select("doc_id"), "dropped").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: some words in windows of test items, and a twentieth of all words or more.

    Texts that are null or without words stay; repeated rows share their fate.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return remove_documents(decontaminate(docs, items)).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked, overlapping ones by one mark. Null stays null."""
    masked = mask_secrets(scan_secrets(docs, train(docs)))
    return masked.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all packed sequences, with their token ids; a null or empty text is its end id alone."""
    return pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("benchmarks", benchmarks), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
