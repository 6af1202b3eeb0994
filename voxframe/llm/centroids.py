"""Centroid clustering of vectors, exact by float32 screening with rigorous rounding-error intervals.

Vectors and centroids are whole numbers, so squared distances are too. A task multiplies a batch of vectors with
all centroids in float32 and puts an interval around each product that its rounding can't leave. A centroid
whose interval lies wholly above another's can't be the nearest; where one is left, it is, and where several
are, their distances are computed in whole numbers and ties go to the lowest number. The result is that of
exact arithmetic throughout, whatever order a matrix product adds in.

Tasks return sums for each cluster, not vectors: k rows for some thousand vectors, which Spark adds up. Only centroids,
k rows whatever the size of the table, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed, prepare, table

WIDTH, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: The greatest squared norm of a vector; so the squared distance of any two, and of one and a centroid, stays within 63 bits.
LIMIT = 1 << 60
#: Vectors that are multiplied at a time.
BATCH_ROWS = 4096
#: Vectors after which a task returns its sums; so many components of up to 2**30 add up to less than 2**63.
SUM_ROWS = 1 << 20

_EPS32, _EPS64 = 2.0**-24, 2.0**-53


def whole_vectors(column: pa.Array, width: int = WIDTH, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are kept, and their components as whole numbers, floor(scale * x).

    Kept are lists of exactly ``width`` numbers, none null or non-finite, whose squared norm, scaled, is LIMIT at the most.
    """
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    values = column.take(pa.array(rows)).flatten()
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), width)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
        near = np.einsum("ij,ij->i", x, x) <= LIMIT * 1.001  # false for NaN; what is left fits whole numbers of 64 bits
    rows, x = rows[near], x[near].astype(np.int64)
    good = np.einsum("ij,ij->i", x, x) <= LIMIT
    return rows[good], x[good]


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows of whole numbers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def error_bounds(x_norm: np.ndarray, c_norm: np.ndarray, width: int) -> np.ndarray:
    """What the float32 product of rows with these Euclidean norms may be off, at the most, for each pair.

    With unit rounding error u both factors are rounded once, and a sum of n products in any order, fused or
    not, rounds each term n times at the most: n + 2 factors of (1 + u), so the error is at most
    g = (n+2)u / (1 - (n+2)u) times the sum of the terms' magnitudes, which is at most the product of the norms. One
    factor more covers the rounding of the norms and of the bound itself. Whole numbers don't underflow, and of norms within LIMIT not overflow.
    """
    m = (width + 3) * _EPS32
    return (m / (1 - m)) * np.outer(x_norm, c_norm)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row, ties to the lowest number, and how many rows needed whole numbers."""
    n, k = len(x), len(centroids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    c_square = np.einsum("ij,ij->i", centroids, centroids)
    x_norm = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))
    c_norm = np.sqrt(c_square.astype(np.float64))
    # The distance without the vector's own square, which all centroids share.
    score = c_square.astype(np.float64) - 2 * product
    off = 2 * error_bounds(x_norm, c_norm, x.shape[1]) + 4 * _EPS64 * (c_square + 2 * np.abs(product))
    possible = score - off <= (score + off).min(axis=1)[:, None]
    best = possible.argmax(axis=1)
    open_ = np.flatnonzero(possible.sum(axis=1) > 1)
    if len(open_):
        row, number = np.nonzero(possible[open_])
        exact = np.full((len(open_), k), np.iinfo(np.int64).max)
        exact[row, number] = squared_distances(x[open_[row]], centroids[number])
        best[open_] = exact.argmin(axis=1)  # the first of equal ones
    return best, squared_distances(x, centroids[best]), len(open_)


def _steps(batches: Iterator[pa.RecordBatch], width: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            rows, x = whole_vectors(part.column(1), width, scale)
            if len(rows):
                yield part, rows, x


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = 2, width: int = WIDTH, scale: float = SCALE) -> np.ndarray:
    """The kept vectors with the least SHA-256 of ``seed:vec_id``, in ascending order; a null vec_id has an empty name, ties go by components."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in _steps(batches, width, scale):
            data = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), data], ["vec_id", "x"])

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select("vec_id", "embedding").mapInArrow(kept, "vec_id long, x array<long>")
    first = rows.withColumn("h", F.sha2(name.cast("binary"), 256)).orderBy("h", "x").limit(clusters).select("x").collect()  # ``clusters`` rows
    return np.array([r["x"] for r in first], np.int64).reshape(-1, width)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray, width: int = WIDTH, scale: float = SCALE) -> DataFrame:
    """(cluster, n, s): number and componentwise sums of the vectors nearest to each centroid."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)

        def result() -> pa.RecordBatch:
            there = np.flatnonzero(count)
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * width, pa.int32()), pa.array(total[there].ravel()))
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(count[there]), sums], ["cluster", "n", "s"])

        for _, _, x in _steps(batches, width, scale):
            best, _, _ = nearest(x, centroids)
            order = np.argsort(best, kind="stable")
            there, head, n = np.unique(best[order], return_index=True, return_counts=True)
            count[there] += n
            total[there] += np.add.reduceat(x[order], head, axis=0)
            if count.sum() >= SUM_ROWS:
                yield result()
                count[:], total[:] = 0, 0
        if count.any():
            yield result()

    parts = vectors.select("vec_id", "embedding").mapInArrow(add, "cluster int, n long, s array<long>")
    sums = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).select("cluster", "n", F.array(*[f"s{i}" for i in range(width)]).alias("s"))


def moved_centroids(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Each centroid replaced by its vectors' componentwise floor(sum / count); one without vectors stays."""
    out = centroids.copy()
    for row in sums.collect():  # a row for each centroid
        out[row["cluster"]] = [int(s) // row["n"] for s in row["s"]]
    return out


def _assigned(centroids: np.ndarray, width: int, scale: float):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in _steps(batches, width, scale):
            best, distance, _ = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return assign


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2, width: int = WIDTH, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's rounds over vectors(vec_id, embedding): (vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept are embeddings of exactly ``width`` components, none null or non-finite; each becomes floor(scale * x). A vector whose squared norm
    then exceeds LIMIT, four million in units of x, isn't kept either, as its squared distance may exceed 64 bits. All arithmetic is exact, the nearest
    centroid of equally near ones is that of the lowest number. With fewer kept vectors than ``clusters`` there are as many
    centroids as vectors; without any there is no row. Rows that repeat, or share a vec_id, null too, each count and each
    give a row. Other columns are ignored. The table is read once for each round and twice besides.
    """
    prepare(vectors.sparkSession)
    centroids = first_centroids(vectors, clusters, seed, width, scale)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved_centroids(centroids, cluster_sums(vectors, centroids, width, scale))
    return vectors.select("vec_id", "embedding").mapInArrow(_assigned(centroids, width, scale), "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (distances summed over the cluster and over all) and centroid_sha256 to what :func:`cluster` returns."""
    assigned = checkpointed(assigned)
    spark = assigned.sparkSession
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each centroid
    inertia = sum(sums.values())
    rows = [(k, sums.get(k, 0), inertia, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    own = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """Rounds written out one after the other, in whole numbers."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT v, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept ORDER BY h, v LIMIT {CLUSTERS}))"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'cluster': cluster}}) AS best
  FROM (SELECT r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{k}) GROUP BY r)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT best.cluster AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY cluster, i),
c{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{k} LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS m FROM s{k} GROUP BY cluster) USING (cluster))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.cluster = best.cluster"""


OP11_SQL = _sql()
