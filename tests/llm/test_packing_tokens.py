import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from voxframe.llm import packing, queries, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b ", "日本語 テスト\n\tx", "▁a b▁", "<s> </s> <unk> <0x41>", "é" * 50, "ab" * 300, "\x00 a", "😀😀 x", "<|endoftext|> a", "a\x85b  c　d", "don't I'll 12,345 x"]


def optimum(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins)}.values():
            if bins[b] + items[i] <= capacity:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_is_part_of_an_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 30])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
    counts = [items.count(n) for n in range(capacity + 1)]
    rest = list(counts)
    fixed = packing.reduce_dominated(rest, capacity)
    left = [n for n, c in enumerate(rest) for _ in range(c)]
    assert sum(p.bins for p in fixed) + (optimum(left, capacity) if left else 0) == optimum(items, capacity)
    held = [0] * (capacity + 1)
    for items_, bins in packing.pack_lengths(counts, capacity):
        assert sum(size * times for size, times in items_) <= capacity
        for size, times in items_:
            held[size] += times * bins
    assert held == counts


def test_runs_pack_as_single_pieces_do():
    """Best fit on runs of equal pieces gives as many sequences as piece by piece."""
    rng = random.Random(1)
    for _ in range(50):
        capacity = 100
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 80))), reverse=True)
        room = []
        for x in items:
            fit = [k for k, r in enumerate(room) if r >= x]
            if fit:
                room[min(fit, key=lambda k: room[k])] -= x
            else:
                room.append(capacity - x)
        counts = [items.count(n) for n in range(capacity + 1)]
        assert sum(p.bins for p in packing.best_fit(counts, capacity)) == len(room)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def check_pieces(rows, got, tokenizer, capacity=1024):
    want = {}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        head = len(ids) - (len(ids) - 1) // capacity * capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())), []).append(1)
    from collections import Counter

    assert Counter(tuple(r)[:5] for r in got) == Counter({k: len(v) for k, v in want.items()})
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert ends[r.sequence_id] <= capacity
    return len(ends), -(-sum(r.length for r in got) // capacity)


def test_packing_query(spark, sf_dir, texts, tokenizer):
    used, least = check_pieces(texts, queries.QUERIES["op9_best_fit_packing"](spark, sf_dir).collect(), tokenizer)
    assert used <= least * 1.02 + 1


def test_packing_in_order(spark, documents, texts, tokenizer, edge, edge_rows, empty):
    """Sequences of a window hold its documents alone and follow their order; all windows but the last are full."""
    order = {i: k for k, (i, _) in enumerate(sorted(texts))}
    places = spark.createDataFrame([(i, k // 70, k % 70) for i, k in order.items()], "doc_id long, part long, at long")
    rows = documents.join(places, "doc_id")
    got = packing.pack_in_order(rows, BPE, (F.col("part"), F.col("at")), window_rows=60).collect()
    used, least = check_pieces(texts, got, tokenizer)
    assert used <= least * 1.02 + 4 and {r.sequence_id for r in got} == set(range(used))
    windows, first = {}, {}
    for r in got:
        windows.setdefault(r.sequence_id, set()).add(order[r.doc_id] // 60)
        first[r.sequence_id] = min(first.get(r.sequence_id, (1 << 30, 0)), (order[r.doc_id], r.piece))
    assert all(len(w) == 1 for w in windows.values())
    assert [first[k] for k in range(used)] == sorted(first.values())
    at = edge.withColumn("_at", F.monotonically_increasing_id())
    line = F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("_at")) - 1
    numbered = at.withColumn("_file", F.spark_partition_id().cast("long")).withColumn("_row", line)
    check_pieces([r[:2] for r in edge_rows], packing.pack_in_order(numbered, BPE, (F.col("_file"), F.col("_row").cast("long"))).collect(), tokenizer)
    assert packing.pack_in_order(empty, BPE, (F.lit(0).cast("long"), F.lit(0).cast("long"))).count() == 0


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing_of_edge_rows(edge, edge_rows, empty, tokenizer, capacity):
    check_pieces([r[:2] for r in edge_rows], packing.pack(edge, BPE, capacity).collect(), tokenizer, capacity)
    assert packing.pack(empty, BPE, capacity).count() == 0


def test_fast_ids_equal_the_tokenizer(tokenizer, texts):
    encode = packing.encoder(BPE).encode_ordinary
    for text in ODD + [t or "" for _, t in texts]:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_long_whitespace(spark, tokenizer):
    """Runs on which tiktoken runs out of stack."""
    rows = [(1, "a" + " " * 1_200_000 + "b"), (2, "\n" * 1_200_000 + "a"), (3, "a b" + "\t" * 1_200_000), (4, "a" + " " * 10_000 + "b" + "\t\n" * 5_001)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    check_pieces(rows, packing.pack(docs, BPE).collect(), tokenizer)


def test_added_tokens_are_read_as_the_file_says(spark):
    """Ids equal those of an unmodified tokenizer."""
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"  {end}\n\n{end}  x", f"<|{end}|>", f"a{end[:-1]} {end}b", f"{end}" + " " * 20_000 + f"a {end}"]
    rows = list(enumerate([*texts, *ODD]))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    check_pieces(rows, packing.pack(docs, BPE).collect(), Tokenizer.from_file(BPE))


@pytest.fixture(scope="module")
def unigram():
    t = Tokenizer(models.Unigram(token_counts.read_vocabulary(PIECES), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always")
    return t


def test_counts_equal_the_unigram_tokenizer(unigram, texts):
    counter = token_counts.Counter(token_counts.read_vocabulary(PIECES))
    for text in ODD + [t or "" for _, t in texts]:
        assert counter.count(text) == len(unigram.encode(text, add_special_tokens=False).ids), text[:40]


def test_ties_go_to_the_longer_piece():
    vocabulary = [("<unk>", -9.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -1.0), ("bc", -2.0), ("abc", -3.0)]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0))
    counter = token_counts.Counter(vocabulary)
    for text in ("ab", "abc", "abab", "bcab", "aabcb"):
        assert counter.best(text)[1] == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_of_edge_rows(spark, sf_dir, edge, edge_rows, empty, unigram):
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(edge, PIECES).collect())
    assert got == sorted((r[0] or 0, len(unigram.encode(r[1] or "", add_special_tokens=False).ids)) for r in edge_rows)
    assert token_counts.token_counts(empty, PIECES).count() == 0
    assert queries.QUERIES["op3_token_counts"](spark, sf_dir).count() == 200
