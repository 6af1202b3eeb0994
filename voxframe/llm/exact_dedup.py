"""Exact deduplication by recipes of content-defined chunks.

Each text becomes a recipe, the ordered list of its chunks. Chunks end where a rolling hash of the last
32 bytes is zero in its upper bits, so equal passages fall into equal chunks wherever they stand. A chunk
dictionary gives every chunk a verified identifier: its 64-bit fingerprint, unless two chunks of different
SHA-256 share the fingerprint, which then get numbers of their own. Texts are equal if their lists of
identifiers are equal. Only fingerprints, digests and identifiers are shuffled, never a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import checkpointed, prepare, table, text_or_empty
from .textbytes import blocks, mixed
from .whole_texts import NO_ID

#: Chunks hold at least SHORTEST and at most LONGEST bytes, and about 2**MEAN_BITS on average.
SHORTEST, LONGEST, MEAN_BITS = 256, 16384, 11

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

_RECIPE = "doc_id long, n_bytes long, text_sha256 string, recipe array<struct<fp:long,digest:binary>>"
_RECIPE_ARROW = pa.list_(pa.struct([("fp", pa.int64()), ("digest", pa.binary())]))


def cut_points(data: np.ndarray) -> np.ndarray:
    """Offsets after which a chunk may end: the gear hash of the 32 bytes before them has MEAN_BITS zero upper bits."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_ends(candidates: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the text in [start, end): the first candidate from SHORTEST on, LONGEST at most."""
    ends, at = [], start
    inside = candidates[np.searchsorted(candidates, start) : np.searchsorted(candidates, end)]
    while at < end:
        k = int(np.searchsorted(inside, at + SHORTEST))
        to = int(inside[k]) if k < len(inside) else end
        at = min(to, at + LONGEST, end)
        ends.append(at)
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in blocks(batches):
        candidates, raw = cut_points(data), data.tobytes()
        sizes, shas, recipes = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            at, recipe = a, []
            for to in chunk_ends(candidates, a, b):
                chunk = raw[at:to]
                recipe.append({"fp": xxhash.xxh3_64_intdigest(chunk) - (1 << 63), "digest": hashlib.sha256(chunk).digest()})
                at = to
            sizes.append(b - a)
            shas.append(hashlib.sha256(raw[a:b]).hexdigest())
            recipes.append(recipe)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(recipes, _RECIPE_ARROW)], ["doc_id", "n_bytes", "text_sha256", "recipe"])


def recipes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, text_sha256 and its recipe. An empty text has an empty one."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_recipes, _RECIPE)


def shared_fingerprints(recipe: DataFrame) -> DataFrame:
    """Chunks whose fingerprint stands for more than one content, with an identifier for each; as a rule none.

    A fingerprint of one content is its own identifier. The count of contents needs no list of them: the
    least and greatest digest differ if there are two.
    """
    chunks = recipe.select(F.explode("recipe").alias("c")).select("c.fp", "c.digest")
    mixed_up = chunks.groupBy("fp").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("fp")
    contents = chunks.join(mixed_up, "fp").distinct()
    return contents.withColumn("n", F.row_number().over(Window.partitionBy("fp").orderBy("digest")))


def verified_lists(recipe: DataFrame) -> DataFrame:
    """doc_id, n_bytes, text_sha256 and ``ids``, the ordered list of (fingerprint, number) of its chunks.

    The number is 0 unless a fingerprint is shared, so only documents with such a chunk are looked up.
    """
    recipe = checkpointed(recipe.withColumn("row", F.monotonically_increasing_id()))
    shared = checkpointed(shared_fingerprints(recipe))
    plain = F.transform("recipe", lambda c: F.struct(c["fp"].alias("fp"), F.lit(0).alias("n")))
    if shared.isEmpty():
        return recipe.select("doc_id", "n_bytes", "text_sha256", plain.alias("ids"))
    places = recipe.select("row", F.posexplode("recipe").alias("pos", "c")).select("row", "pos", "c.fp", "c.digest")
    places = places.join(shared, ["fp", "digest"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lists = places.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "fp", "n"))).alias("p"))
    ids = F.transform("p", lambda c: F.struct(c["fp"].alias("fp"), c["n"].alias("n")))
    return recipe.join(lists, "row", "left").select("doc_id", "n_bytes", "text_sha256", F.coalesce(ids, plain).alias("ids"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every document with the document of its text that stays.

    Returns doc_id, keep_id (largest doc_id of the same text), group_size (rows of ``docs`` with this
    text), kept, text_sha256, n_bytes, one row for each row of ``docs``. Null texts equal empty ones. Rows that
    repeat both doc_id and text are one document: each gives its row, with the same values, and all count in
    group_size. A null doc_id sorts below all others, so such a row stays only if all doc_ids of its text are
    null. Other columns of ``docs`` are ignored.
    """
    lists = verified_lists(recipes(docs))
    groups = lists.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # A third of all rows may share one list; the sort-merge join splits such a partition.
    return lists.join(groups.hint("merge"), "ids").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns, whatever these are named.

    Of rows that repeat both doc_id and text one stays.
    """
    id_or_none = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")
    groups = exact_groups(docs).where("kept").select(id_or_none, F.col("text_sha256").alias("sha"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), id_or_none, F.sha2(text_or_empty().cast("binary"), 256).alias("sha"))
    return rows.join(groups.hint("merge"), ["doc", "sha"], "left_semi").dropDuplicates(["doc", "sha"]).select("row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
