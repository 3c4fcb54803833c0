"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents that the one before it kept, as stored Parquet.
The first four return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.llm import common, decontaminate, linededup, packing, quality, shingle_join
from canopygrid.llm.queries import tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below the threshold."""
    labels = common.read(spark, sf_dir, "labels").filter(quality.remainder(F.col("doc_id"), 4) != 2)
    return quality.accepted(docs, quality.train(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates."""
    return linededup.deduplicated(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return shingle_join.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes benchmark passages, and documents that are mostly such passages."""
    return decontaminate.cleaned(docs, common.read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the trained classifier, the template tree or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that all stages keep."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
