import random
import re

import numpy as np
import pytest
import xxhash

from voxframe.llm import components, queries, simhash
from voxframe.llm.textbytes import signed


def brute_fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    """Least id of each component; None sorts last."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def check(rows, got):
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    key = lambda r: tuple(-1 if v is None else v for v in r[:1]) + r[1:2] + tuple(-1 if v is None else v for v in r[2:])
    assert sorted(map(key, got)) == sorted(key((i, f"{f:016x}", c)) for (i, _), f, c in zip(rows, fps, want))


def kept_rows(rows):
    """The rows that stay where each component keeps its smallest doc_id."""
    component = brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    return sorted((r for r, c in zip(rows, component) if r[0] is None or r[0] == c), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_near_copies_dropped_with_all_columns(edge, edge_rows, empty):
    kept = simhash.drop_near_copies(edge)
    assert kept.columns == edge.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert got == kept_rows([r[:2] for r in edge_rows])
    assert simhash.drop_near_copies(empty).count() == 0


def test_edge_rows(edge, edge_rows):
    check([r[:2] for r in edge_rows], [tuple(r) for r in simhash.near_duplicates(edge).collect()])


def test_query(spark, sf_dir, texts):
    check(texts, [tuple(r) for r in queries.QUERIES["op8_simhash_near_dedup"](spark, sf_dir).collect()])


@pytest.mark.parametrize("seed,sampled", [(0, 64), (1, 64), (2, 1), (3, 1)])
def test_links_connect_all_that_is_near(spark, seed, sampled, monkeypatch):
    """Clusters of fingerprints a few bits apart, chains among them; no cell listed as large, or all of six or more."""
    if sampled == 1:
        monkeypatch.setattr(simhash, "SAMPLED", 1)
        monkeypatch.setattr(simhash, "CELL_ROWS", 12)
    rng = random.Random(seed)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            fps.add(f)
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(x),) for x in signed(np.array(fps, np.uint64))], "fp long").repartition(3)
    labels = {r.node: r.component for r in components.connected_components(simhash.fingerprint_links(nodes)).collect()}
    assert (len(simhash.large_cells(nodes)) > 0) == (sampled == 1)
    numbers = signed(np.array(fps, np.uint64)).tolist()
    want = brute_components(list(numbers), fps)
    assert [labels.get(n, n) for n in numbers] == want


def test_parts_of_listed_cells_go_their_own_ways():
    key = np.array([5 << 24 | 1, 5 << 24 | 2, 5 << 24 | 1, 6 << 24 | 1, 6 << 24 | 2], np.uint64)
    large = np.array([5], np.uint64)
    found = simhash.routes(key, large).tolist()
    assert found[0] == found[2] != found[1] and found[3] == found[4] == 6
    assert simhash.routes(key, large[:0]).tolist() == [5, 5, 5, 6, 6]


def test_bound_is_below_distance():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    counts = lambda x: np.array([[(int(v) >> k & 3).bit_count() for k in range(0, 64, 2)] for v in x])
    low = np.bitwise_count(simhash.embedded(a) ^ simhash.embedded(b))
    assert (low == np.abs(counts(a) - counts(b)).sum(axis=1)).all() and (low <= np.bitwise_count(a ^ b)).all()


def test_long_chain_of_links(spark):
    links = spark.range(300).selectExpr("(id * 7) % 307 as a", "((id + 1) * 7) % 307 as b")
    got = components.connected_components(links).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_cells_and_parts_stay_whole(size, monkeypatch):
    """Cells of all sizes, cut into batches of any size: the links connect what brute force connects, and only bounded runs are held."""
    import pyarrow as pa

    rng = np.random.default_rng(size)
    monkeypatch.setattr(simhash, "CELL_ROWS", 50)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    # Fingerprints with the same counts in every segment, hence one cell of each choice: 01 and 10 at random.
    middle = np.uint64(0x5555555555555555) << rng.integers(0, 2, (600, 1), dtype=np.uint64)
    swap = rng.integers(0, 1 << 63, 600, dtype=np.uint64) & np.uint64(0x5555555555555555)
    one = np.uint64(0x5555555555555555) ^ (swap | swap << np.uint64(1))
    near = one[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, base ^ np.uint64(3), middle[:, 0], one, near]))
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = []
    for key in simhash.cell_keys(fps):
        order = np.argsort(signed(key), kind="stable")
        table = pa.table({"key": signed(key)[order], "fp": signed(fps)[order]})
        for k, f in simhash.whole_cells(iter(table.to_batches(max_chunksize=size))):
            held.append(len(k))
            for x, y in zip(*simhash.cell_links(k, f)):
                assert (int(x) ^ int(y)).bit_count() <= 4
                parent[find(int(x))] = find(int(y))
    groups = {}
    for f, c in zip(fps.tolist(), brute_components(list(range(len(fps))), fps.tolist())):
        groups.setdefault(c, set()).add(find(f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    assert size > 50 or max(held) <= 250


def test_a_hundred_thousand_fingerprints_of_one_cell(spark):
    """All counts are one, so every fingerprint is in the same 70 cells: parts keep the work near linear."""
    rng = np.random.default_rng(1)
    swap = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) & np.uint64(0x5555555555555555)
    fps = np.uint64(0x5555555555555555) ^ (swap | swap << np.uint64(1))
    # Each has a partner with one segment turned, 01 for 10, which are two bits.
    turned = fps ^ (np.uint64(3) << (rng.integers(0, 32, len(fps), dtype=np.uint64) * np.uint64(2)))
    nodes = np.unique(np.concatenate([fps, turned]))
    assert len(np.unique(simhash.embedded(nodes))) == 1
    links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in signed(nodes)], "fp long").repartition(4)).toPandas()
    found = set(zip(links["a"], links["b"]))
    pair = zip(np.minimum(signed(fps), signed(turned)).tolist(), np.maximum(signed(fps), signed(turned)).tolist())
    first = {}

    def find(x):
        while first.setdefault(x, x) != x:
            x = first[x]
        return x

    for a, b in found:
        first[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in pair)
