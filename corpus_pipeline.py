"""A training corpus from ``documents``: quality, exact and near duplicates, benchmark leaks, packed sequences.

Each stage takes the documents that its predecessor kept and returns the columns of ``documents``; the last returns
the packed pieces. A document without an id cannot be named by a decision, so only the quality stage may drop it.
Rows that repeat a document's id share its decisions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tyche.llm.decontamination import contaminated
from tyche.llm.exact_dedup import exact_duplicates
from tyche.llm.ngram_join import similar_components
from tyche.llm.packing import pack_documents
from tyche.llm.quality import keep_quality
from tyche.llm.shared import kept, table

QUALITY = 0.3
NEAR_WORDS, NEAR_PERCENT = 5, 80
SEQUENCE = 2048


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` but for those whose doc_id ``dropped`` names."""
    return docs.join(dropped.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least ``QUALITY``."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents, that with the smallest id."""
    return without(docs, exact_duplicates(docs).filter(~F.col("kept")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles, that with the smallest id."""
    found = similar_components(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)
    return without(docs, found.filter(F.col("doc_id") != F.col("component_id")))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark"), every=True))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=SEQUENCE, end_id=0)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("best-fit packing", packed),
]

#: A trained model decides in the first stage: no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
