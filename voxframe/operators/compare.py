"""Two volumes side by side, on top of each other, and through world coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import to_voxel, to_world
from ..functions.intensity import blend
from ..functions.numeric import clamp, half_up
from ..session import ship_package
from .voxels import DATA

#: Voxels that one Arrow batch holds, about.
BATCH_VOXELS = 1 << 20


def aligned(vox: DataFrame, header: DataFrame, other_header: DataFrame) -> DataFrame:
    """Adds bx, by, bz to ``vox``: the voxel of the other volume at the same world point, rounded.

    Headers are keyed by ``pair``, which ``vox`` carries; the columns of the other one get the prefix b_.
    """
    named = other_header.select("pair", *[F.col(c).alias(f"b_{c}") for c in other_header.columns if c != "pair"])
    both = vox.join(header, "pair").join(named, "pair")
    world = to_world(F.col("x"), F.col("y"), F.col("z"))
    placed = both.withColumns({"wx": world[0], "wy": world[1], "wz": world[2]})
    back = to_voxel(F.col("wx"), F.col("wy"), F.col("wz"), "b_")
    return placed.withColumns({f"b{a}": half_up(c) for a, c in zip("xyz", back)}).select(*vox.columns, "bx", "by", "bz")


def affine_images() -> Column:
    """From voxel to voxel is one affine map: the images of the origin and of a step along each axis, one after another.

    The columns are those of a volume's header and, with the prefix b_, those of the other's; worked out once a pair.
    """
    corners = F.array(*[F.struct(*[F.lit(float(v)).alias(a) for a, v in zip("xyz", point)]) for point in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))])
    return F.flatten(F.transform(corners, lambda p: F.array(*to_voxel(*to_world(p["x"], p["y"], p["z"]), "b_"))))


def compare(volumes: DataFrame, header: DataFrame, others: DataFrame, other_header: DataFrame) -> DataFrame:
    """(pair, x, y, z, v, other): each voxel of volumes(pair, nx, ny, nz, data) with the value of ``others``, alike, at its
    world point, null where that lies outside.

    Volumes meet by ``pair``, a row each, so this is for small ones; ``slabwise.compare`` joins those of any size by bricks.
    The other's voxels are looked up in its array by numpy, those of many pairs at once, and never shuffled one by one.
    """
    ship_package(volumes.sparkSession)
    named = other_header.select("pair", *[F.col(c).alias(f"b_{c}") for c in other_header.columns if c != "pair"])
    right = others.select("pair", *[F.col(c).alias(f"other_{c}") for c in ("nx", "ny", "nz", DATA)])
    both = volumes.select("pair", "nx", "ny", DATA).join(header, "pair").join(named, "pair").join(right, "pair", "left")
    both = both.select("pair", "nx", "ny", "other_nx", "other_ny", "other_nz", affine_images().alias("images"), DATA, f"other_{DATA}")
    kind, name = volumes.schema[DATA].dataType.elementType.simpleString(), volumes.schema["pair"].dataType.simpleString()
    return both.mapInArrow(_looked_up, f"pair {name}, x int, y int, z int, v {kind}, other {others.schema[DATA].dataType.elementType.simpleString()}")


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All values of a list column, and where each row's begin (and the last one's end)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.append(0, np.cumsum(sizes)).astype(np.int64)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each voxel of a volume with the voxel of the other one that the affine map of ``images`` points at; about BATCH_VOXELS, of any rows, at a time."""
    for rows in batches:
        values, first = _flat(rows.column(7))
        others, other_first = _flat(rows.column(8))
        pair = rows.column(0)
        nx, ny, *sides = (rows.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 6))
        image = rows.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 3)
        step = image[:, 1:] - image[:, :1]
        for at in range(0, int(first[-1]), BATCH_VOXELS):
            k = np.arange(at, min(at + BATCH_VOXELS, int(first[-1])))
            row = np.searchsorted(first, k, "right") - 1
            i = k - first[row]
            place = [i % nx[row], i // nx[row] % ny[row], i // (nx * ny)[row]]
            b = [np.floor(image[row, 0, c] + (step[row, 0, c] * place[0] + step[row, 1, c] * place[1] + step[row, 2, c] * place[2]) + 0.5) for c in range(3)]
            inside = np.logical_and.reduce([(b[c] >= 0) & (b[c] < sides[c][row]) for c in range(3)])
            x, y, z = (np.where(inside, c, 0).astype(np.int64) for c in b)
            seen = other_first[row] + x + sides[0][row] * (y + sides[1][row] * z)
            columns = [pair.take(pa.array(row)), *(pa.array(p.astype(np.int32)) for p in place), values.slice(at, len(k)), others.take(pa.array(seen, mask=~inside))]
            yield pa.RecordBatch.from_arrays(columns, ["pair", "x", "y", "z", "v", "other"])


def aligned_slice(index: Column, axis_world: Column, n_other: Column) -> Column:
    """The other volume's slice for a world position, clamped to the volume."""
    return clamp(half_up(axis_world), 0, n_other - 1)


def overlay(first: DataFrame, second: DataFrame, size: tuple[int, int], other_size: tuple[int, int], opacity: float, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(pair, u, w, channels...): the second picture stretched over the first, nearest pixel, and blended.

    Pictures are (pair, u, w, channels...); a pixel's centre decides which one of the stretched picture it shows.
    """
    (w0, h0), (w1, h1) = size, other_size
    left = first.withColumns({"ku": F.floor((F.col("u") + 0.5) * w1 / w0).cast("int"), "kw": F.floor((F.col("w") + 0.5) * h1 / h0).cast("int")})
    right = second.select("pair", F.col("u").alias("ku"), F.col("w").alias("kw"), *[F.col(c).alias(f"b_{c}") for c in channels])
    mixed = [F.when(F.col(f"b_{c}").isNull(), F.col(c).cast("double")).otherwise(blend(F.col(c).cast("double"), F.col(f"b_{c}").cast("double"), opacity)).alias(c) for c in channels]
    return left.join(right, ["pair", "ku", "kw"], "left").select("pair", "u", "w", *mixed)


def overlay_pictures(first: DataFrame, second: DataFrame, opacity: float, channels: tuple[str, ...] = ("data",)) -> DataFrame:
    """(pair, nx, ny, channels...): as :func:`overlay`, of pictures (pair, nx, ny, channels...) whose pixels are arrays, row by row.

    Pictures meet by ``pair``, one row each, and pixels are looked up in place; a picture without a second one stays as it is.
    """
    other = second.select("pair", F.col("nx").alias("b_nx"), F.col("ny").alias("b_ny"), *[F.col(c).alias(f"b_{c}") for c in channels])
    both = first.join(other, "pair", "left")

    def mixed(name: str) -> Column:
        def pixel(v: Column, i: Column) -> Column:
            u, w = F.floor((i % F.col("nx") + 0.5) * F.col("b_nx") / F.col("nx")), F.floor((F.floor(i / F.col("nx")) + 0.5) * F.col("b_ny") / F.col("ny"))
            under = F.element_at(F.col(f"b_{name}"), (w * F.col("b_nx") + u + 1).cast("int")).cast("double")
            return F.when(F.col("b_nx").isNull() | under.isNull(), v.cast("double")).otherwise(blend(v.cast("double"), under, opacity))

        return F.transform(name, pixel).alias(name)

    return both.select("pair", "nx", "ny", *[mixed(c) for c in channels])


def side_by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both pictures, told apart by ``side``."""
    return first.withColumn("side", F.lit("left")).unionByName(second.withColumn("side", F.lit("right")))
