"""Volumes as relations of voxels, and their slices.

At rest a volume is one row with its voxels in an array, x fastest; ``vox`` form has one row for each voxel,
(vol_id, i, x, y, z, v). Slices cut the array before they explode it, so a slice costs its own voxels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from ..functions.numeric import clamp

#: Name of the array column of volumes at rest.
DATA = "data"
#: Sides of the volumes that vectors of 64 numbers are taken for; no two are equal.
VECTOR_SIDES = (8, 4, 2)


def volumes_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """(vol_id, label, nx, ny, nz, data): each vector of 64 numbers is a volume of VECTOR_SIDES."""
    sides = [F.lit(n).alias(c) for c, n in zip(("nx", "ny", "nz"), VECTOR_SIDES)]
    return embeddings.select(F.col("vec_id").alias("vol_id"), "label", *sides, F.col("embedding").alias(DATA))


def voxels(volumes: DataFrame, *keep: str) -> DataFrame:
    """All voxels of volumes(vol_id, nx, ny, nz, data), with further columns to keep."""
    flat = volumes.select("vol_id", "nx", "ny", *keep, F.posexplode(DATA).alias("i", "v"))
    x = (F.col("i") % F.col("nx")).cast("int")
    y = F.expr("cast((i div nx) % ny as int)")
    z = F.expr("cast(i div (nx * ny) as int)")
    return flat.select("vol_id", *keep, "i", x.alias("x"), y.alias("y"), z.alias("z"), "v")


def _at(kind: str, k: Column) -> tuple[Column, Column, Column]:
    """For an axis: the part of the array that holds slice k, the slice's width, and whether k is in range."""
    nx, ny, nz, data = (F.col(c) for c in ("nx", "ny", "nz", DATA))
    if kind == "axial":
        return F.slice(data, k * nx * ny + 1, (nx * ny).cast("int")), nx, k.between(0, nz - 1)
    if kind == "coronal":
        rows = F.transform(F.sequence(F.lit(0), nz - 1), lambda z: F.slice(data, (z * ny + k) * nx + 1, nx.cast("int")))
        return F.flatten(rows), nx, k.between(0, ny - 1)
    if kind == "sagittal":
        # Spark may look at the cells of volumes that the index isn't in before it leaves these out.
        cells = F.transform(F.sequence(F.lit(0), (ny * nz - 1).cast("int")), lambda r: F.try_element_at(data, F.greatest(F.lit(1), r * nx + k + 1).cast("int")))
        return cells, ny, k.between(0, nx - 1)
    raise ValueError(f"no axis named {kind!r}; there are {', '.join(AXES)}")


def _spread(slices: DataFrame, *keep: str) -> DataFrame:
    """A row for each voxel of slices(vol_id, axis, idx, width, part)."""
    flat = slices.select("vol_id", "axis", "idx", "width", *keep, F.posexplode("part").alias("p", "v"))
    return flat.select("vol_id", "axis", "idx", F.expr("cast(p % width as int)").alias("u"), F.expr("cast(p div width as int)").alias("w"), "v", *keep)


def slice_voxels(volumes: DataFrame, axis: str, index: Column | int, *keep: str) -> DataFrame:
    """(vol_id, axis, idx, u, w, v): one slice of each volume, u across and w up; none where the index is out of range.

    Axial slices have (x, y), coronal ones (x, z), sagittal ones (y, z). ``index`` may be an expression over the volume's columns.
    """
    k = index if isinstance(index, Column) else F.lit(index)
    k = k.cast("int")
    part, width, inside = _at(axis, k)
    slices = volumes.where(inside).select("vol_id", F.lit(axis).alias("axis"), k.alias("idx"), width.alias("width"), part.alias("part"), *keep)
    return _spread(slices, *keep)


def slice_clamped(volumes: DataFrame, axis: str, index: Column | int, *keep: str) -> DataFrame:
    """As :func:`slice_voxels`, with the nearest slice where the index is out of range."""
    n = F.col({"axial": "nz", "coronal": "ny", "sagittal": "nx"}[axis])
    k = index if isinstance(index, Column) else F.lit(index)
    return slice_voxels(volumes, axis, clamp(k, 0, n - 1), *keep)


def middle_slices() -> Column:
    """The three middle slices of a volume at rest, as an array of (axis, idx, width, part)."""
    middle = {"axial": F.expr("nz div 2"), "coronal": F.expr("ny div 2"), "sagittal": F.expr("nx div 2")}
    parts = []
    for axis in AXES:
        part, width, _ = _at(axis, middle[axis].cast("int"))
        parts.append(F.struct(F.lit(axis).alias("axis"), middle[axis].cast("int").alias("idx"), width.cast("int").alias("width"), part.alias("part")))
    return F.array(*parts)


def preview(volumes: DataFrame, *keep: str) -> DataFrame:
    """The middle slice along each axis, as :func:`slice_voxels`, in one pass over the volumes."""
    return _spread(volumes.select("vol_id", *keep, F.inline(middle_slices())), *keep)


def probe(volumes: DataFrame, points: DataFrame) -> DataFrame:
    """(vol_id, x, y, z, v) at points(vol_id, x, y, z); v is null outside the volume."""
    inside = F.col("x").between(0, F.col("nx") - 1) & F.col("y").between(0, F.col("ny") - 1) & F.col("z").between(0, F.col("nz") - 1)
    at = F.when(inside, (F.col("x") + F.col("nx") * (F.col("y") + F.col("ny") * F.col("z")) + 1).cast("int"))
    value = F.when(inside, F.try_element_at(F.col(DATA), F.coalesce(at, F.lit(1))))
    return points.join(volumes, "vol_id").select("vol_id", "x", "y", "z", value.alias("v"))


def target_pixels(at: Column, n: Column, size: int) -> Column:
    """The pixels, of ``size`` in a row, whose nearest source among ``n`` is number ``at``: a range, empty where sources outnumber pixels."""
    first, after = (F.ceil((at + k) * float(size) / n).cast("int") for k in (0, 1))
    return F.filter(F.sequence(first, F.greatest(first, after - 1)), lambda p: p < after)


def resampled(slices: DataFrame, width: Column, height: Column, out_w: int, out_h: int) -> DataFrame:
    """Nearest-neighbour picture of out_w x out_h of each slice (vol_id, u, w, v), top row first: (vol_id, mx, my, v).

    Each source voxel is spread over the range of target pixels that fall on it, so no join is needed.
    """
    wide = slices.select("vol_id", "v", "w", F.explode(target_pixels(F.col("u"), width, out_w)).alias("mx"))
    return wide.select("vol_id", "mx", F.explode(target_pixels(height - 1 - F.col("w"), height, out_h)).alias("my"), "v")


def flipped(slices: DataFrame, height: Column) -> DataFrame:
    """Slices as drawn, row 0 at the top."""
    return slices.withColumn("w", (height - 1 - F.col("w")).cast("int"))


def append_volume(images: DataFrame, more: DataFrame) -> DataFrame:
    """The collection with another one after it; ``pos`` orders both."""
    last = images.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_last"))
    return images.unionByName(more.crossJoin(F.broadcast(last)).withColumn("pos", F.col("pos") + F.col("_last") + 1).drop("_last"))


def remove_at(images: DataFrame, position: int) -> DataFrame:
    """The collection without one position; later ones move up."""
    return images.where(F.col("pos") != position).withColumn("pos", F.when(F.col("pos") > position, F.col("pos") - 1).otherwise(F.col("pos")))
