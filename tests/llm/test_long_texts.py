"""Very long texts through every operator and the pipeline: runs of white space, one huge word, a text of more than a block."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from voxframe.llm import exact_dedup, media_ogg, mixing, packing, quality, simhash, suffix_dedup, textbytes, token_counts, warc_fixity, window_dedup

from test_dedup import _by_text, brute_exact, brute_suffixes, brute_windows
from test_media_mixing_fixity import check_media
from test_packing_tokens import BPE, PIECES, check_pieces, unigram  # noqa: F401
from test_quality import slow_features
from test_simhash import check


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    word = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    words = [f"{rng.randrange(10**9):x}" + "é" * 20 for _ in range(48_000)]
    long_ = " ".join(words)
    assert len(long_.encode()) > textbytes.BLOCK_BYTES
    return [(1, " " * 1_000_000 + "a"), (2, "\n" * 1_000_000), (3, word), (4, long_), (5, long_[1000:30_000] + " end"), (6, None), (7, "short text of a few words")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_scores(spark, docs, rows):
    labels = spark.createDataFrame([(4, 1), (7, 0)], "doc_id long, label int")
    weights, bias = model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert set(got) == {i for i, _ in rows} and weights.any()
    features = slow_features(rows[4][1])
    import numpy as np

    total = weights.astype(np.float32).astype(float)[features].sum() * quality.SCALE / len(features)
    assert got[5] == pytest.approx(1 / (1 + np.exp(-(bias + total))))


def test_counts(docs, rows, unigram):  # noqa: F811
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PIECES).collect()}
    assert got == {i: len(unigram.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_dedup(docs, rows):
    got = Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs, with_text=False).drop("kept").collect())
    assert got == _by_text(rows, brute_suffixes)
    got = Counter(tuple(r)[:4] for r in window_dedup.remove_windows(docs, with_text=False).drop("kept").collect())
    assert got == _by_text(rows, brute_windows)
    assert Counter(tuple(r)[:5] for r in exact_dedup.exact_groups(docs).collect()) == brute_exact(rows)
    check(rows, [tuple(r) for r in simhash.near_duplicates(docs).collect()])


def test_mixing_packing_and_media(docs, rows):
    mixed = mixing.mix(docs, columns=["doc_id"]).collect()
    assert sorted(r.row.doc_id for r in mixed) == [i for i, _ in rows]
    end = {}
    for r in sorted(mixed, key=lambda r: (r.source, r.at)):
        assert r.at == end.get(r.source, 0) and r.source_block == r.at // mixing.BLOCK_BYTES
        end[r.source] = r.at + max(1, len((dict(rows)[r.row.doc_id] or "").encode()))
    check_pieces(rows, packing.pack(docs, BPE).collect(), Tokenizer.from_file(BPE))
    check_media(rows, media_ogg.read_media(media_ogg.to_media(docs)).collect())


def test_fixity(spark, rows):
    pages = spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in rows], "page_id long, url string, html string")
    hashes = warc_fixity.record_hashes(warc_fixity.page_records(pages))
    assert hashes.count() == len(rows)
    other = warc_fixity.record_hashes(warc_fixity.page_records(pages.where("page_id <> 3")))
    assert [(r.status, r.length > 1_000_000) for r in warc_fixity.audit(hashes, other).collect()] == [("missing", True)]


def test_pipeline(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= {i for i, _ in rows}
    assert public_tokenizers.path("byte_bpe_50k.json") == BPE
