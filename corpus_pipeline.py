"""From documents to packed windows: quality rules, near copies, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents. What a stage
wrote besides, and its predecessor's table, are removed then.

Defined cases: a document whose text is null, empty or blank goes with the first
stage; a null language or source is one of its own; documents without an id are
never copies of others, keep their rows in every stage and share a random number
in the mixing; of equal rows the second stage keeps one; very long texts are read
and packed whole, in as many windows as they need; ties go to the lesser id; an
empty table gives an empty result; extra columns, whatever their names, are kept
up to the last stage, which returns its own columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import jaccard_join, kernels, quality_rules, secret_scan, source_mix, window_packing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return window_packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: Perplexity models, LSH forests and bin packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        with kernels.scratch() as keep:
            docs = keep(stage(spark, docs, sf_dir))
        if before is not None:
            kernels.discard(before)
        before = docs
    return docs
