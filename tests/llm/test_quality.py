import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxframe.llm import quality, queries
from voxframe.llm.textbytes import column_bytes


def test_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.QUERIES["op2_quality_classifier"](spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert (rows.predicted == rows.quality).mean() > 0.95
    assert (rows.predicted == (rows.score >= 0.5)).all() and rows.score.between(0, 1).all()
    good = rows[rows.quality == 1]
    assert (good.predicted == 1).mean() > 0.99


def test_held_out_labels_are_not_learned(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, quality.learnable(labels))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.fit(docs, quality.learnable(turned))
    assert model[1] == other[1] and np.array_equal(model[0], other[0]) and model[0].any()


def _scores(texts, weights, bias):
    return quality.scores(weights, bias, *column_bytes(pa.array(texts)))


def test_block_scores_equal_single_ones():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=1 << quality.BITS)
    texts = ["", "a", "a a a b", " x  y\n", "THE!! THE!! 12 é", "word " * 50]
    together = _scores(texts, weights, 0.25)
    assert np.allclose(together, [_scores([t], weights, 0.25)[0] for t in texts])
    for text, score in zip(texts, together):
        index, count = quality._counted(*column_bytes(pa.array([text])))
        x = quality._frequencies(count)
        assert score == pytest.approx(1 / (1 + np.exp(-(weights[index] @ x + 0.25))))
    assert together[0] == pytest.approx(1 / (1 + np.exp(-0.25)))


def test_training_follows_the_regularised_leader():
    """One weight by hand: the closed form of the update after each example."""
    texts, labels = [(np.array([3]), np.array([1.0]))] * 4, np.array([1.0, 1.0, 0.0, 1.0])
    weights, bias = quality.train_ftrl(texts, labels, 1)
    z = n = zb = nb = 0.0
    for y in labels:
        w = 0.0 if abs(z) <= quality.L1 else (np.sign(z) * quality.L1 - z) / ((quality.BETA + n**0.5) / quality.ALPHA + quality.L2)
        wb = -zb / ((quality.BETA + nb**0.5) / quality.ALPHA)
        g = 1 / (1 + np.exp(-(w + wb))) - y
        z += g - ((n + g * g) ** 0.5 - n**0.5) / quality.ALPHA * w
        zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / quality.ALPHA * wb
        n, nb = n + g * g, nb + g * g
    w = (np.sign(z) * quality.L1 - z) / ((quality.BETA + n**0.5) / quality.ALPHA + quality.L2)
    assert weights[3] == pytest.approx(w) and bias == pytest.approx(-zb / ((quality.BETA + nb**0.5) / quality.ALPHA))


def test_edge_rows_and_odd_labels(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (6, 1), (6, 1), (16, 0), (None, 1), (17, 7)], "doc_id long, label int")
    model = quality.fit(edge, labels)
    assert quality.score_quality(edge, model).count() == edge.count()
    assert quality.keep_good(edge, model, 0.0).columns == edge.columns
    assert quality.keep_good(edge, model, 0.0).count() == edge.count()
    assert quality.keep_good(edge, model, 1.1).count() == 0
    none = quality.fit(empty, labels)
    assert not none[0].any() and {r.score for r in quality.score_quality(edge, none).collect()} == {0.5}
    assert quality.score_quality(empty, model).count() == 0


def test_training_rows_are_bounded(spark, documents):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    assert quality.fit(documents, labels, max_rows=40)[0].any()


def test_equal_texts_have_equal_scores(spark, documents):
    """Whatever stands beside a text, and however rows are dealt, its score is the same to the last bit."""
    rng = np.random.default_rng(7)
    model = (rng.normal(size=1 << quality.BITS), 0.1)
    twice = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 10**6))
    one, two = ({r.doc_id: r.score for r in quality.score_quality(twice.repartition(n, "doc_id"), model).collect()} for n in (2, 7))
    assert one == two and all(one[i] == one[i + 10**6] for i in one if i < 10**6)


MASK = (1 << 64) - 1


def slow_mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def slow_hash(items, seed):
    """The polynomial hash of bytes or numbers, by its definition."""
    base = slow_mixed(seed) | 1
    if isinstance(items, bytes):
        items = [slow_mixed((b + 1) * base & MASK) for b in items]
    total = sum(v * pow(base, k, 1 << 64) for k, v in enumerate(items)) & MASK
    return slow_mixed(total ^ len(items) * 0x9E3779B97F4A7C15 & MASK)


def slow_features(text):
    """Index of each feature of a text, word by word."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    shaped = lambda b: 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
    shapes = [bytes(k for k, _ in itertools.groupby(map(shaped, w))) for w in words]
    word, shape = ([slow_hash(x, seed) for x in xs] for xs, seed in ((words, 11), (shapes, 12)))
    out = []
    for k in range(len(words)):
        w1, w2 = word[k - 1] if k > 0 else 0, word[k - 2] if k > 1 else 0
        s1 = shape[k - 1] if k > 0 else 0
        kinds = [word[k], word[k] ^ w1 * 31 & MASK, shape[k], shape[k] ^ s1 * 31 & MASK, (word[k] == w1) + 2 * (word[k] == w2)]
        out += [slow_mixed(h + kind * 0x632BE59BD9B4E019 & MASK) >> 64 - quality.BITS for kind, h in enumerate(kinds, 1)]
    return out


def slow_training(rows):
    """FTRL-proximal over (features, label), one weight at a time: a dict of weights, and the bias under None."""
    z, n = {}, {}

    def weight(k):
        x, root = z.get(k, 0.0), math.sqrt(n.get(k, 0.0))
        if k is None:
            return -x / ((quality.BETA + root) / quality.ALPHA)
        return 0.0 if abs(x) <= quality.L1 else (math.copysign(quality.L1, x) - x) / ((quality.BETA + root) / quality.ALPHA + quality.L2)

    for features, y in rows * quality.EPOCHS:
        x = {k: c * quality.SCALE / len(features) for k, c in Counter(features).items()} | {None: 1.0}
        w = {k: weight(k) for k in x}
        p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
        for k, v in x.items():
            g, old = (p - y) * v, n.get(k, 0.0)
            z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * w[k]
            n[k] = old + g * g
    return {k: weight(k) for k in z}


def test_query_against_training_from_scratch(spark, sf_dir, documents):
    """Features, held-out rule, shards, updates, averages and scores, all anew in plain Python."""
    from pyspark.sql.types import LongType, StructField, StructType

    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    ids = spark.createDataFrame([(i,) for i in labels], StructType([StructField("doc_id", LongType())]))
    order = {r.doc_id: r.h for r in ids.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    shards = {}
    for i in sorted((i for i in labels if i in texts and not held[i]), key=order.get):
        shards.setdefault((order[i] >> 24) % quality.SHARDS, []).append((slow_features(texts[i]), labels[i]))
    weights = {}
    for rows in shards.values():
        for k, w in slow_training(rows).items():
            weights[k] = weights.get(k, 0.0) + w / len(shards)
    got = {r.doc_id: r for r in queries.QUERIES["op2_quality_classifier"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        features = slow_features(text)
        total = sum(weights.get(k, 0.0) for k in features) * quality.SCALE / max(1, len(features))
        score = 1 / (1 + math.exp(-(weights[None] + total)))
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].held_out == held[i] and got[i].predicted == (got[i].score >= 0.5)
