"""Each stage against brute force on its own input, on rows with exact and near copies and junk."""

import pytest

import corpus_pipeline
from voxframe.llm import mixing, quality, queries
from voxframe.llm.runtime import table
from voxframe.session import written

from test_packing_tokens import BPE, check_pieces
from test_simhash import kept_rows


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, written(stage(spark, docs, sf_dir))[0]))
        docs = out[-1][1]
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages, documents):
    assert all(after.columns == documents.columns for _, after in stages[:-1])


def test_rejected_documents_go(spark, sf_dir, stages):
    docs, kept = stages[0]
    model = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    good = {r.doc_id for r in quality.score_quality(docs, model).where("score >= 0.5").collect()}
    assert {i for i, _ in pairs(kept)} == good


def test_one_of_equal_texts_stays(stages):
    docs, kept = map(pairs, stages[1])
    want = {}
    for i, t in docs:
        want[t or ""] = max(want.get(t or "", i), i)
    assert sorted(kept) == sorted((i, t) for t, i in want.items()) and len(kept) < len(docs)


def test_one_of_near_copies_stays(stages):
    docs, kept = map(pairs, stages[2])
    assert sorted(kept) == kept_rows(docs) and len(kept) < len(docs)


def test_mixing_keeps_all_and_its_order_reaches_the_sequences(stages):
    docs, mixed = stages[3]
    assert sorted(pairs(docs)) == sorted(pairs(mixed))
    file, row = mixing.file_order(mixed)
    order = [r.doc_id for r in mixed.select("doc_id", file.alias("f"), row.alias("r")).orderBy("f", "r").collect()]
    assert order == [r.doc_id for r in mixing.mix(docs, columns=["doc_id"]).orderBy("mix_block", "source", "at").select("row.doc_id").collect()]
    first = {}
    for r in stages[4][1].collect():
        first[r.sequence_id] = min(first.get(r.sequence_id, 1 << 30), order.index(r.doc_id))
    assert [first[k] for k in sorted(first)] == sorted(first.values())


def test_packed(spark, sf_dir, stages):
    from tokenizers import Tokenizer

    docs, packed = stages[4]
    used, least = check_pieces(pairs(docs), packed.collect(), Tokenizer.from_file(BPE))
    assert used <= least * 1.02 + 1
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_all_are_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{k}" for k in range(1, 14)} and len(corpus_pipeline.STAGES) == 5
