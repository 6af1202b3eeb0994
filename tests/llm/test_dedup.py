"""Exact, suffix and window dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm import exact_dedup, queries, suffix_dedup, window_dedup

LAST = 1 << 62


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha(t.encode())) for i in ids]
    return Counter(out)


def test_exact_groups_of_edge_rows(edge, edge_rows):
    got = [tuple(r)[:5] for r in exact_dedup.exact_groups(edge).collect()]
    assert Counter(got) == brute_exact([r[:2] for r in edge_rows])


def test_exact_sql_of_edge_rows(edge, edge_rows):
    """Code, SQL and brute force follow one rule where rows repeat."""
    import duckdb
    import pandas as pd

    documents = pd.DataFrame([r[:2] for r in edge_rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"})
    con = duckdb.connect()
    con.register("documents", documents)
    rows = con.sql(queries.ORACLE_SQL["op6_exact_dedup"]).fetchall()
    assert Counter(rows) == brute_exact([r[:2] for r in edge_rows])


def test_exact_query(spark, sf_dir, duck, same_rows):
    same_rows(queries.QUERIES["op6_exact_dedup"](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL["op6_exact_dedup"]).df())


def test_exact_copies_dropped_with_all_columns(edge, empty):
    kept = exact_dedup.drop_exact_copies(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert len(rows) == edge.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert [r.doc_id for r in rows if r.text and len(r.text.split()) == 60] == [7]
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_shared_fingerprint_is_told_apart(spark):
    """Two contents under one fingerprint get identifiers of their own, so their texts aren't equal."""
    schema = "doc_id long, n_bytes long, text_sha256 string, recipe array<struct<fp:long,digest:binary>>"
    rows = [(1, 9, "a", [(7, b"x"), (8, b"z")]), (2, 9, "b", [(7, b"y"), (8, b"z")]), (3, 9, "a", [(7, b"x"), (8, b"z")]), (4, 0, "e", [])]
    lists = {r.doc_id: [tuple(x) for x in r.ids] for r in exact_dedup.verified_lists(spark.createDataFrame(rows, schema)).collect()}
    assert lists[1] == lists[3] != lists[2] and lists[4] == [] and lists[1][1] == (8, 0)


def test_chunks_follow_content():
    data = np.frombuffer(np.random.default_rng(1).bytes(200_000), np.uint8)
    moved = np.concatenate([data[:777], data])
    a, b = (exact_dedup.chunk_ends(exact_dedup.cut_points(x), 0, len(x)) for x in (data, moved))
    assert a[-1] == len(data) and len(set(a) & {e - 777 for e in b}) > 0.9 * len(a)
    sizes = np.diff([0, *a])
    assert sizes.max() <= exact_dedup.LONGEST and sizes[:-1].min() >= exact_dedup.SHORTEST


def brute_suffixes(rows, depth=100):
    """(doc_id, text) -> result; copies under one doc_id are one document, null doc_ids come last."""
    from xxhash import xxh64_intdigest

    seen, out = set(), {}
    tag = lambda t: xxh64_intdigest(t.encode(), 42) - (1 << 64 if xxh64_intdigest(t.encode(), 42) >> 63 else 0)
    order = sorted({(LAST if i is None else i, tag(t or ""), t or "") for i, t in rows})
    for i, _, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if w in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[None if i == LAST else i, t] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


def _by_text(rows, brute):
    want = brute(rows)
    return Counter((i, *want[i, t or ""]) for i, t in rows)


@pytest.mark.parametrize("depth,gram", [(100, 20), (40, 8)])
def test_suffixes_of_edge_rows(edge, edge_rows, depth, gram):
    rows = [r[:2] for r in edge_rows]
    got = Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(edge, depth, gram).drop("kept").collect())
    assert got == _by_text(rows, lambda x: brute_suffixes(x, depth))


def test_suffix_query(spark, sf_dir, texts):
    got = Counter(tuple(r) for r in queries.QUERIES["op4_suffix_dedup"](spark, sf_dir).collect())
    assert got == _by_text(texts, brute_suffixes)


@pytest.mark.parametrize("name", ["op4_suffix_dedup", "op5_window_dedup"])
def test_queries_equal_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


def test_suffix_text_is_what_the_digest_says(edge):
    for r in suffix_dedup.remove_repeats(edge).collect():
        assert sha(bytes(r.kept)) == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def brute_windows(rows, window=35):
    words = [(i, t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = Counter(tuple(w[p : p + window]) for _, _, w in words for p in range(len(w) - window + 1))
    out = {}
    for i, t, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out[i, t] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


@pytest.mark.parametrize("window,period,cover", [(35, 21, (3, 6, 7, 12, 14)), (10, 7, (1, 2, 4))])
def test_windows_of_edge_rows(edge, edge_rows, window, period, cover):
    rows = [r[:2] for r in edge_rows]
    got = Counter(tuple(r)[:4] for r in window_dedup.remove_windows(edge, window, period, cover).drop("kept").collect())
    assert got == _by_text(rows, lambda x: brute_windows(x, window))


def test_window_query(spark, sf_dir, texts):
    got = Counter(tuple(r) for r in queries.QUERIES["op5_window_dedup"](spark, sf_dir).collect())
    assert got == _by_text(texts, brute_windows)


def thue_morse(k):
    """Two words of 2**k letters that differ in each, and collide in every polynomial hash modulo 2**64 from 1,024 letters on."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("k", [10, 12])
def test_windows_of_words_that_collide(spark, k):
    one, other = thue_morse(k)
    h = window_dedup._WORD
    data = np.frombuffer((one + other).encode(), np.uint8)
    n = len(one)
    assert len(set(h.spans(h.prefix(data), np.array([0, n]), np.array([n, 2 * n])).tolist())) == 1
    words = [f"w{i}" for i in range(40)]
    with_ = lambda w, n=34: " ".join([*words[:n], w])
    rows = [(1, with_(one)), (2, with_(other)), (3, with_(one) + " between the two " + with_(other)), (4, with_(other, 20)), (5, " ".join([one] * 35)), (6, " ".join([other] * 35))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for docs in (df, df.repartition(3)):
        got = Counter(tuple(r)[:4] for r in window_dedup.remove_windows(docs, with_text=False).drop("kept").collect())
        assert got == _by_text(rows, brute_windows)
    alone = df.where("doc_id IN (1, 4, 5, 6)")
    assert {r.n_removed for r in window_dedup.remove_windows(alone).collect()} == {0}


def test_cover_has_every_difference():
    assert {(a - b) % window_dedup.PERIOD for a in window_dedup.COVER for b in window_dedup.COVER} == set(range(window_dedup.PERIOD))


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert window_dedup.remove_windows(empty).count() == 0


@pytest.mark.parametrize("rows,share", [(1, 0), (4, 0), (1000, 0), (1000, 1), (1000, 3)])
def test_digits_too_frequent_for_one_task(rows, share, monkeypatch, edge_rows):
    """The passes in this process, with a few rows in memory at a time, or with none, all or a third of the grams frequent: same result."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "TASK_ROWS", rows)
    texts = sorted({t for _, t in ((r[0], r[1] or "") for r in edge_rows)} | {f"{'head of a line ' * 3}{k} " + "common line of eighty bytes " * 3 + f" {k * 7}" for k in range(40)})
    plain = pa.record_batch({"doc": pa.array(range(len(texts)), pa.int64()), "tag": pa.array([0] * len(texts), pa.int64()), "text": pa.array(texts)})

    def dealt(batches):
        table = pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in ("one", "two", "doc", "tag", "place")])
        return iter(table.to_batches(max_chunksize=3))

    def listed(batches):
        table = pa.Table.from_batches(list(batches))
        places = defaultdict(list)
        for d, p in zip(table.column("doc").to_pylist(), table.column("place").to_pylist()):
            places[d].append(p)
        out = plain.append_column("places", pa.array([places.get(d, []) for d in range(len(texts))], pa.list_(pa.int64())))
        return out

    frequent = np.zeros(0, np.uint64)
    if share:
        from voxframe.llm.textbytes import column_bytes

        frequent = np.unique(suffix_dedup.suffix_runs(*column_bytes(pa.array(texts)))[0])[::share]
    marks = suffix_dedup._second_pass(100, 20)(dealt(suffix_dedup._first_pass(100, 20, frequent)(iter([plain]))))
    marks = suffix_dedup._third_pass(dealt(suffix_dedup._refine(100, suffix_dedup.STEP)(iter([listed(marks)]))))
    marks = suffix_dedup._last_pass(dealt(suffix_dedup._refine(100, 1)(iter([listed(marks)]))))
    cut = suffix_dedup._cut_out(100, False)(iter([listed(marks).append_column("sha", pa.array([""] * len(texts))).select(["sha", "doc", "text", "places"])]))
    got = [tuple(r.values())[2:6] for b in cut for r in b.to_pylist()]
    want = brute_suffixes(list(enumerate(texts)))
    assert got == [want[k, t] for k, t in enumerate(texts)]


def test_frequent_grams_of_a_common_line(spark, monkeypatch):
    line = "this line stands in every text, among others that differ from one text to the next one"
    rng = np.random.default_rng(4)
    other = lambda: " ".join(rng.choice(list("abcdefghij"), 6).tobytes().decode("utf-32-le") for _ in range(30))
    docs = spark.createDataFrame([(k, f"{other()}\n{line}\n{other()}") for k in range(300)], "doc_id long, text string").repartition(2)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    found = suffix_dedup.frequent_grams(docs)
    assert 0 < len(found) <= 1 / suffix_dedup.FREQUENT
    from voxframe.llm.textbytes import column_bytes
    import pyarrow as pa

    assert set(found) <= set(suffix_dedup.suffix_runs(*column_bytes(pa.array([line * 3])))[0]) | set(suffix_dedup.suffix_runs(*column_bytes(pa.array([r.text for r in docs.collect()])))[0])
    # Beyond TASK_ROWS sampled rows a gram is frequent whatever its share, and the list is never longer than MOST.
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 2.0)
    assert not len(suffix_dedup.frequent_grams(docs))
    monkeypatch.setattr(suffix_dedup, "TASK_ROWS", suffix_dedup.SEEN)
    assert set(suffix_dedup.frequent_grams(docs)) >= set(found)
    monkeypatch.setattr(suffix_dedup, "MOST", 2)
    assert len(suffix_dedup.frequent_grams(docs)) == 2
    got = Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs).drop("kept").collect())
    assert got == _by_text([(r.doc_id, r.text) for r in docs.collect()], brute_suffixes)
