import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import textbytes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 9), st.sampled_from([None, 1, 3, 8]))
def test_keys_stay_whole_unless_too_large(values, size, limit):
    table = pa.table({"k": pa.array(sorted(values), pa.int64()), "i": pa.array(range(len(values)), pa.int64())})
    parts = list(textbytes.whole_keys(iter(table.to_batches(max_chunksize=size)), "k", limit))
    seen = [i for part, _ in parts for i in part.column("i").to_pylist()]
    assert sorted(set(seen)) == list(range(len(values)))
    for (a, cut_a), (b, cut_b) in zip(parts, parts[1:]):
        last, first = a.column("k")[-1], b.column("k")[0]
        if last == first:
            assert limit is not None and cut_a and cut_b and a.column("i")[-1] == b.column("i")[0]
        elif limit is None:
            assert not cut_a and not cut_b
    for part, cut in parts:
        assert not cut or len(set(part.column("k").to_pylist())) == 1


@given(st.lists(st.text("aé \n\t\x0b", max_size=12), max_size=6))
@settings(max_examples=80, deadline=None)
def test_words(texts):
    import re

    data, offsets = textbytes.column_bytes(pa.array(texts, pa.string()))
    starts, ends, words = textbytes.word_spans(data, offsets)
    raw = data.tobytes()
    for k, text in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(starts[words[k] : words[k + 1]], ends[words[k] : words[k + 1]])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_span_hashes_don_t_depend_on_place():
    rng = random.Random(1)
    word = bytes(rng.randrange(256) for _ in range(40))
    data = np.frombuffer(b"x" * 17 + word + b"yy" + word, np.uint8)
    h = textbytes.SpanHash(5)
    a, b, c = h.spans(h.prefix(data), np.array([17, 59, 18]), np.array([57, 99, 58]))
    assert a == b != c
    assert h.windows(h.prefix(data), 40)[17] == h.windows(h.prefix(data), 40)[59]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 9, 69])
def test_sliding_minimum(width):
    x = np.random.default_rng(width).integers(0, 1000, 300).astype(np.uint64)
    assert textbytes.sliding_minimum(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]


def test_blocks_hold_all_rows():
    texts = ["a" * n for n in (0, 5, 50, 0, 3, 200, 1)] + [None]
    batch = pa.record_batch({"text": pa.array(texts)})
    got = [bytes(data[a:b]).decode() for _, data, offsets in textbytes.blocks(iter([batch]), limit=60) for a, b in zip(offsets, offsets[1:])]
    assert got == [t or "" for t in texts]
