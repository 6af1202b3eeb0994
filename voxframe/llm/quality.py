"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its word unigrams and bigrams, the same of the words' shapes (letters by case,
digits and punctuation with repeats squeezed), and for each word which of the two words before it equal
it. All are hashed to 2**BITS weights; a text's vector is the relative frequency of each, so long texts
weigh no more than short ones. A score is the logistic of the sparse dot product of vector and weights.

Training takes at most ``max_rows`` labelled texts, spread by a hash of doc_id; each of SHARDS shards is
trained by FTRL-proximal updates in its own task and the shards' weights are averaged. Only the averaged
weights, at most 2**BITS numbers whatever the input, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, table, text_or_empty
from .textbytes import SpanHash, blocks, column_bytes, mixed, word_spans

BITS = 18
MAX_ROWS, SHARDS, EPOCHS = 16_000, 8, 2
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.02, 0.01
#: Relative frequencies are scaled by this, so that weights stay of order one.
SCALE = 8.0
#: Weights are averaged as whole multiples of this, so that the order of the shards doesn't matter.
STEP = 2.0**-30

U64 = np.uint64

# Shape of a byte: A for upper case, a for lower case and letters beyond ASCII, 0 for digits, others themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")

_WORD, _SHAPES = SpanHash(11), SpanHash(12)
KINDS = 5


def _salted(h: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(h + U64(kind * 0x632BE59BD9B4E019 % (1 << 64))) >> U64(64 - BITS)).astype(np.int32)


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each kind of feature the hashed index at each word of the block, and the words before each text (and in all)."""
    starts, ends, words = word_spans(data, offsets)
    if not len(starts):
        return [np.zeros(0, np.int32)] * KINDS, words
    word = _WORD.spans(_WORD.prefix(data), starts, ends)
    shape_bytes = _SHAPE[data]
    kept = np.ones(len(data), bool)
    kept[1:] = shape_bytes[1:] != shape_bytes[:-1]
    kept[starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shape = _SHAPES.spans(_SHAPES.prefix(shape_bytes[kept]), place[starts], place[ends])
    first = np.zeros(len(starts) + 1, bool)
    first[words[:-1]] = True
    first = first[:-1]

    def before(h: np.ndarray, k: int) -> np.ndarray:
        """The value k words back, zero beyond the text's start."""
        out = np.zeros_like(h)
        out[k:] = h[:-k]
        far = first.copy()
        for step in range(1, k):
            far[step:] |= first[:-step]
        out[far] = 0
        return out

    w1, w2 = before(word, 1), before(word, 2)
    pattern = (word == w1).astype(U64) + (word == w2).astype(U64) * U64(2)
    s1 = before(shape, 1)
    return [_salted(word, 1), _salted(word ^ (w1 * U64(31)), 2), _salted(shape, 3), _salted(shape ^ (s1 * U64(31)), 4), _salted(pattern, 5)], words


def scores(weights: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of the block's texts; a text without words has no feature, so its score is that of the bias.

    Each text's sum is its own, so equal texts have equal scores whatever stands beside them.
    """
    kinds, words = hashed_ngrams(data, offsets)
    total, some = np.zeros(len(offsets) - 1), np.flatnonzero(np.diff(words))
    for index in kinds:
        if len(some):
            total[some] += np.add.reduceat(weights[index].astype(np.float64), words[some])
    return 1 / (1 + np.exp(-(bias + SCALE * total / np.maximum(1, KINDS * np.diff(words)))))


def train_ftrl(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates in the order given; each text is its feature indices and values."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for _ in range(epochs):
        for (index, x), y in zip(texts, labels):
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            wb = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w @ x + wb, -40, 40)))
            g = (p - y) * x
            z[index] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[index] = ni + g * g
            gb = p - y
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA * wb
            nb += gb * gb
    root = np.sqrt(n)
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + root) / ALPHA + L2)), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA))


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices, ascending, of one text's features and how often each occurs."""
    kinds, _ = hashed_ngrams(data, offsets)
    return np.unique(np.concatenate(kinds), return_counts=True)


def _frequencies(count: np.ndarray) -> np.ndarray:
    """Values of a vector: each word counts once of each kind."""
    return count * (SCALE / max(1, int(count.sum())))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as sparse counts, 2**BITS at the most, however long they are."""
    for rows in batches:
        for at in range(rows.num_rows):
            row = rows.slice(at, 1)
            index, count = _counted(*column_bytes(row.column(row.schema.get_field_index("text"))))
            kept = [row.column(row.schema.get_field_index(c)) for c in ("doc_id", "label", "order", "digest")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([index.astype(np.int32)]), pa.array([count.astype(np.int32)])], ["doc_id", "label", "order", "digest", "index", "count"])


def _train_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["order", "doc_id"])
    texts = [(index, _frequencies(count)) for index, count in zip(rows["index"], rows["count"])]
    weights, bias = train_ftrl(texts, rows["label"].to_numpy(float))
    index = np.flatnonzero(weights)
    fixed = np.round(np.append(weights[index], bias) / STEP).astype(np.int64)
    return pd.DataFrame({"index": np.append(index, -1).astype(np.int32), "weight": fixed})


def held_out():
    """True for the third of doc_ids whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias learned from ``labels(doc_id, label)``, from ``max_rows`` labelled texts at the most.

    Doc_ids with differing labels, null labels or labels other than 0 and 1 teach nothing; of several texts
    of one doc_id the one of the least SHA-256 does. Texts become sparse counts before the shuffle. Without any label both are zero and every score is 0.5.
    """
    prepare(docs.sparkSession)
    clean = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    clean = clean.select("doc_id", "label", F.xxhash64("doc_id").alias("order"))
    n = clean.count()
    # An even spread of hashes: the share of them that makes nine tenths of max_rows, so that chance doesn't exceed it.
    if n > max_rows:
        clean = clean.where(F.pmod("order", F.lit(1 << 20)) < int((1 << 20) * 0.9 * max_rows / n))
    # At most ``max_rows`` rows of three numbers are broadcast.
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(clean), "doc_id")
    rows = rows.select("doc_id", "label", "order", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")
    vectors = rows.mapInArrow(_vectors, "doc_id long, label int, order long, digest string, index array<int>, count array<int>")
    vectors = vectors.groupBy("doc_id", "label", "order").agg(F.min(F.struct("digest", "index", "count")).alias("v")).select("doc_id", "label", "order", "v.index", "v.count")
    shards = vectors.withColumn("shard", F.pmod(F.shiftright("order", 24), F.lit(SHARDS))).groupBy("shard").applyInPandas(_train_shard, "index int, weight long")
    learned = shards.groupBy("index").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).toPandas()
    weights, bias = np.zeros(1 << BITS), 0.0
    if len(learned):
        own = learned["index"] == -1
        trained = int(learned.loc[own, "n"].iloc[0])
        bias = float(learned.loc[own, "w"].iloc[0]) * STEP / trained
        weights[learned.loc[~own, "index"]] = learned.loc[~own, "w"] * STEP / trained
    return weights, bias


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null texts are empty. One row for each row of ``docs``."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for rows, data, offsets in blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores(weights, bias, data, offsets))], ["doc_id", "score"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(scored, "doc_id long, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns, whatever these are named.

    Null texts score as empty ones do, and empty texts by the model's bias alone; with a model that learned nothing every row scores 0.5 and stays. Equal
    texts stay or go together, repeated rows too; a score of exactly ``threshold`` stays. An empty table gives no row. Nothing is shuffled.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for rows, data, offsets in blocks(batches):
            yield rows.filter(pa.array(scores(weights, bias, data, offsets) >= threshold))

    return docs.mapInArrow(kept, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    return score_quality(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
