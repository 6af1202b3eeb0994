"""The corpus pipeline: quality filter, exact and near dedup, source mixing, packing.

Each stage takes what its predecessor kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import exact_dedup, mixing, packing, quality, simhash
from voxframe.llm.runtime import table
from voxframe.session import discard, written


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good: it scores them 0.5 or more."""
    model = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of fingerprints connect, the one with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture; files and their rows follow it, which the next stage reads back."""
    return mixing.in_mixed_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens, packed in windows of the mixture and numbered along it."""
    import public_tokenizers

    return packing.pack_in_order(docs, public_tokenizers.path("byte_bpe_50k.json"), mixing.file_order(docs))


STAGES = [
    ("quality classifier", keep_good_documents),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Training, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; a stage's table goes when the next one's is written, and the last, which the result reads, stays."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, done = written(stage(spark, docs, sf_dir))
        if path:
            discard(spark, path)
        path = done
    return STAGES[-1][1](spark, docs, sf_dir)
