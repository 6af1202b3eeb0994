"""Centroid clustering against plain whole-number arithmetic."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from voxframe.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, x string, n long, distance string"


def brute(rows, clusters=centroids.CLUSTERS, rounds=centroids.ROUNDS, width=centroids.WIDTH):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e):
            v = [int(np.floor(256 * float(np.float32(x)))) for x in e]
            if sum(x * x for x in v) <= 1 << 60:
                kept.append((i, v))
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:clusters]
    cs = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for k in range(len(cs)):
            own = [v for (_, v), (_, b) in zip(kept, best) if b == k]
            if own:
                cs[k] = [sum(column) // len(own) for column in zip(*own)]
    best = assign()
    inertia = Counter()
    for d, k in best:
        inertia[k] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), shas[k]) for (i, _), (d, k) in zip(kept, best))


def edge_vectors():
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(64)]) for k in range(90)]
    rows += [(200 + k, [rng.randrange(-2, 3) / 256 for _ in range(64)]) for k in range(40)]  # near each other, with ties
    rows += [(300, rows[3][1]), (301, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, rows[5][1])]
    rows += [(400, None), (401, []), (402, rows[0][1][:63]), (403, rows[0][1] + [0.0]), (404, [None] + rows[0][1][1:]), (405, [float("nan")] + rows[0][1][1:]), (406, [float("inf")] + rows[0][1][1:])]
    rows += [(407, [1e5] * 64), (408, [-5e5] + [0.0] * 63), (409, [3e38] * 64), (413, [4e6] + [0.0] * 63), (414, [4.2e6] + [0.0] * 63), (415, [-3e6, 2.5e6] + [1.0] * 62), (410, [1e-40] * 64), (411, [-0.0] * 64), (412, [-1e-40] * 64)]
    return rows


def clustered(spark, rows, **more):
    df = spark.createDataFrame([(i, e, 1, 2, "x", 3, "d") for i, e in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in centroids.with_inertia(*centroids.cluster(df, **more)).collect())


def test_edge_vectors(spark):
    assert clustered(spark, edge_vectors()) == brute(edge_vectors())


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = edge_vectors()[:7]
    assert clustered(spark, rows) == brute(rows) and len({r[1] for r in clustered(spark, rows)}) == 7
    assert not clustered(spark, [(1, None), (2, [1.0])])
    assert not clustered(spark, [])


def test_query(spark, sf_dir, duck, same_rows):
    same_rows(queries.QUERIES["op11_centroid_clusters"](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL["op11_centroid_clusters"]).df())


@pytest.mark.parametrize("size", [1, 300, 1 << 20, (1 << 27) - 1])
def test_bounds_hold_and_screening_is_exact(size):
    """The float32 product never leaves its interval, and ties and near ties go to the lowest number."""
    rng = np.random.default_rng(size)
    x = rng.integers(-size, size + 1, (200, 64))
    c = np.concatenate([rng.integers(-size, size + 1, (17, 64)), x[:5], x[:5], x[5:9] + np.eye(64, dtype=np.int64)[:4]])
    product = x.astype(np.float32) @ c.astype(np.float32).T
    bound = centroids.error_bounds(*(np.sqrt((v.astype(float) ** 2).sum(axis=1)) for v in (x, c)), 64)
    exact = x.astype(object) @ c.T.astype(object)
    assert all(abs(Fraction(float(product[i, j])) - int(exact[i, j])) <= Fraction(float(bound[i, j])) for i in range(200) for j in range(len(c)))
    best, distance, opened = centroids.nearest(x, c)
    d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    assert best.tolist() == [row.tolist().index(min(row)) for row in d] and distance.tolist() == [min(row) for row in d]
    assert opened >= 5  # copies of a centroid can't be told apart by products


def test_few_rows_need_whole_numbers():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 32, (5000, 64))).astype(np.int64)
    assert centroids.nearest(x, x[:40])[2] < 200


def test_sums_of_floor_division_below_zero(spark):
    df = spark.createDataFrame([(k, [-1 / 256 if k else 0.0] * 64) for k in range(3)], "vec_id long, embedding array<float>")
    got, final = centroids.cluster(df, clusters=1, rounds=1)
    assert final.tolist() == [[-1] * 64] and got.count() == 3
