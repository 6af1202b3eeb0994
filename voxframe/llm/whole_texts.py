"""Distinct texts keyed for joins, as the duplicate-window operators need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import text_or_empty

#: Stands for a null doc_id, which so sorts after all others.
NO_ID = (1 << 63) - 1


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, tag, sha) of every row: doc is doc_id, or NO_ID; tag and sha are hashes of the whole text."""
    return docs.select("doc_id", _doc(), _tag(), F.sha2(text_or_empty().cast("binary"), 256).alias("sha"))


def _doc() -> Column:
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")


def _tag() -> Column:
    return F.xxhash64(text_or_empty()).alias("tag")


def first_copies(rows: DataFrame) -> DataFrame:
    """(sha, doc, tag, copies) of each distinct text: its first row and the number of its rows."""
    return rows.groupBy("sha").agg(F.min(F.struct("doc", "tag")).alias("k"), F.count("*").alias("copies")).select("sha", "k.doc", "k.tag", "copies")


def distinct_texts(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc, tag, sha, copies, text) of each distinct text, partitioned by doc and tag. The texts are shuffled once."""
    texts = docs.select(_doc(), _tag(), text_or_empty().alias("text")).repartition("doc", "tag").dropDuplicates(["doc", "tag"])
    return texts.join(firsts.hint("merge"), ["doc", "tag"])
