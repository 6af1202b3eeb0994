"""Periodic runs against a search of all periods and places."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import periodic_runs, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_runs(words, shortest=12):
    n, least = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                least.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in least.items())


def planted(doc_id, text):
    words = WORD.findall((text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute(rows):
    out = Counter()
    for doc_id, text in rows:
        words = planted(doc_id, text)
        found = brute_runs(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in found), default=None)
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()] += 1
    return out


def digests(df):
    return Counter(tuple(r) for r in periodic_runs.run_digests(periodic_runs.collapse_runs(periodic_runs.with_planted_runs(df))).collect())


def test_edge_rows(edge, edge_rows):
    assert digests(edge) == brute([r[:2] for r in edge_rows])


def test_empty_table(empty):
    assert not digests(empty) and periodic_runs.collapse_runs(empty).count() == 0


def test_query_equals_brute_force(spark, sf_dir, texts):
    """All documents but the longest, which would take the search too long."""
    short = [(i, t) for i, t in texts if len((t or "").split()) < 1500]
    assert len(short) > 0.9 * len(texts)
    names = {i for i, _ in short}
    got = Counter(tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect() if r.doc_id in names)
    assert got == brute(short) and sum(r[1] > 0 for r in got) > 10


def codes_of(texts):
    words = np.append(0, np.cumsum([len(t) for t in texts]))
    return np.array([ord(c) for t in texts for c in t], np.int64), words


def expected(texts, shortest):
    return [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t, shortest)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=4), st.sampled_from([2, 3, 5, 12, 20]))
def test_runs_of_two_letters(texts, shortest):
    codes, words = codes_of(texts)
    assert [tuple(r) for r in periodic_runs.find_runs(codes, words, shortest).tolist()] == expected(texts, shortest)


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_small_steps(monkeypatch, step):
    """Grids in parts of any size give the same runs; Fibonacci and Thue-Morse words, which are rich in runs, and none."""
    monkeypatch.setattr(periodic_runs, "GRID_STEP", step)
    fibonacci, other = "a", "b"
    while len(fibonacci) < 150:
        fibonacci, other = fibonacci + other, fibonacci
    thue = "".join(str(bin(k).count("1") % 2) for k in range(200))
    texts = [fibonacci, thue, "", "a", "x" * 90, "abc" * 30 + "d" + "abc" * 30]
    codes, words = codes_of(texts)
    assert [tuple(r) for r in periodic_runs.find_runs(codes, words).tolist()] == expected(texts, 12)


def test_extensions():
    rng = random.Random(3)
    for _ in range(30):
        s = "".join(rng.choice("ab" if rng.random() < 0.7 else "c") for _ in range(rng.randrange(2, 300)))
        if rng.random() < 0.5:
            s = s[: rng.randrange(1, 9)] * 40
        ext = periodic_runs.Extensions(np.array([ord(c) for c in s]))
        i = np.array([rng.randrange(len(s) + 1) for _ in range(200)])
        j = np.array([rng.randrange(len(s) + 1) for _ in range(200)])
        i, j = i[i != j], j[i != j]
        for a, b, got in zip(i, j, ext.common(i, j)):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert got == k


def test_long_texts(spark):
    """A million equal words, a long period, and words of many bytes."""
    period = [f"w{k}" for k in range(40_000)]
    rows = [(1, "ab " * 1_000_000), (3, " ".join(period * 3 + period[:7])), (4, "é" * 1_000_000 + " x" * 11), (5, "\n" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapse_runs(df).collect()}
    assert got[1] == (1_000_000, [(0, 1_000_000, 1)], "ab")
    assert got[3] == (120_007, [(0, 120_007, 40_000)], " ".join(period))
    assert got[4] == (12, [], "é" * 1_000_000 + " x" * 11) and got[5] == (0, [], "")
