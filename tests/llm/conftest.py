from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, row string, key long, doc long, tag long, fp long, size long, h long, label int"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, copies, a repeated row, one doc_id with two texts, shared passages, periodic text."""
    rng = random.Random(5)
    passage, long_ = _words(rng, 60), _words(rng, 6000)
    texts = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Zwei  Wörter"), (6, passage), (7, passage), (7, passage), (8, _words(rng, 20) + " " + passage),
        (9, passage.replace("é", "e", 1) + "\x0b" + _words(rng, 40)), (10, long_), (11, long_ + " end"), (12, "ab " * 400), (13, "x" * 700), (14, "x" * 300),
        (15, "first of two"), (15, "second of two"), (None, passage), (None, None), (16, "THE!! " * 50), (17, "日本語テキスト" * 30), (18, _words(rng, 35)), (19, _words(rng, 34)),
        (20, "a\r\nb " * 30 + passage), (21, passage + " " + passage),
    ]
    clash = ("x", "y", 1, 2, 3, 4, 5, 6, 0)
    return [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else f"s{k % 3}", len(t or ""), *clash) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
