"""Aggregations over voxels: ranges, percentiles, block means, projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from .voxels import DATA

#: Samples that a range and a contrast aim at, at the least.
RANGE_SAMPLES, CONTRAST_SAMPLES = 50_000, 10_000
#: Samples along the shortest side of a projection.
MIP_SAMPLES = 80


def _widened(low: Column, high: Column) -> Column:
    """The upper end of a range; one above the lower end if both are equal."""
    return F.when(low == high, low + 1).otherwise(high)


def value_range(vox: DataFrame, widen: bool = True, *keys: str) -> DataFrame:
    """(vol_id, lo, hi) of the values that are numbers; with ``widen`` a range of one value ends one above it."""
    low, high = F.min("v").cast("double"), F.max("v").cast("double")
    return vox.where(~F.isnan("v")).groupBy("vol_id", *keys).agg(low.alias("lo"), (_widened(low, high) if widen else high).alias("hi"))


def _numbers(values: Column) -> Column:
    return F.filter(values, lambda v: ~F.isnan(v))


def array_range(values: Column, widen: bool = True) -> tuple[Column, Column]:
    """As :func:`value_range`, of an array in place: no voxel becomes a row."""
    low, high = F.array_min(_numbers(values)).cast("double"), F.array_max(_numbers(values)).cast("double")
    return low, _widened(low, high) if widen else high


def _strided(step: Column, value) -> Column:
    """``value`` of every step-th voxel of a volume at rest, NaN left out."""
    return _numbers(F.transform(F.sequence(F.lit(0), F.size(DATA) - 1, step), lambda i: value(F.element_at(DATA, i + 1).cast("double"))))


def strided_range(volumes: DataFrame, samples: int = RANGE_SAMPLES, slope: Column | float = 1.0, inter: Column | float = 0.0) -> DataFrame:
    """(vol_id, step, lo, hi) of every step-th rescaled voxel, the step so that at least ``samples`` are seen of a large volume.

    Works on the arrays in place: no voxel becomes a row.
    """
    step = F.greatest(F.lit(1), F.floor(F.size(DATA) / float(samples))).cast("int")
    numbers = _strided(step, lambda v: v * slope + inter)
    low, high = F.array_min(numbers), F.array_max(numbers)
    return volumes.select("vol_id", step.alias("step"), low.alias("lo"), _widened(low, high).alias("hi"))


def auto_window(volumes: DataFrame, samples: int = CONTRAST_SAMPLES) -> DataFrame:
    """(vol_id, p01, p99, win, level): order statistics 1 % and 99 % of every step-th voxel, and the window they span in the volume's range.

    The step is so that at least ``samples`` voxels of a large volume are seen. Ranks are exact and not
    interpolated: the element at floor(n * p) of the sorted samples. NaN is no sample; a volume of nothing
    else has null statistics. Works on the arrays in place.
    """
    step = F.greatest(F.lit(1), F.floor(F.size(DATA) / float(samples))).cast("int")
    low, high = array_range(F.col(DATA), widen=False)
    found = volumes.select("vol_id", F.array_sort(_strided(step, lambda v: v)).alias("s"), low.alias("lo"), high.alias("hi"))

    def at(p: float) -> Column:
        return F.when(F.size("s") > 0, F.element_at("s", (1 + F.floor(F.size("s") * p)).cast("int")))

    found = found.select("vol_id", "lo", "hi", at(0.01).alias("p01"), at(0.99).alias("p99"))
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return found.select("vol_id", "p01", "p99", ((F.col("p99") - F.col("p01")) / span).alias("win"), (((F.col("p01") + F.col("p99")) / 2.0 - F.col("lo")) / span).alias("level"))


def block_mean(slices: DataFrame, width: Column, height: Column, factor: int) -> DataFrame:
    """(vol_id, bx, by, v): mean of each block of factor x factor of slices (vol_id, u, w, v).

    Blocks that the slice doesn't fill are left out, unless a side is shorter than ``factor``: then it is one block.
    """
    bw, bh = (F.greatest(F.lit(1), F.floor(n / float(factor))) for n in (width, height))
    bx, by = F.expr(f"cast(u div {factor} as int)"), F.expr(f"cast(w div {factor} as int)")
    inside = (bx < bw) & (by < bh)
    return slices.where(inside).groupBy("vol_id", bx.alias("bx"), by.alias("by")).agg(F.avg(F.col("v").cast("double")).cast("float").alias("v"))


def lod(slices: DataFrame, width: Column, height: Column, level: int) -> DataFrame:
    """Block means by 2**level."""
    return block_mean(slices, width, height, 1 << level)


def mip_pixel(rot_x: float, rot_y: float, nx: Column, ny: Column, nz: Column, dx: Column | None = None, dy: Column | None = None, dz: Column | None = None) -> tuple[Column, Column]:
    """Pixel of each voxel (x, y, z) under a rotation about the vertical, then the horizontal axis; parallel projection."""
    one = F.lit(1.0)
    dx, dy, dz = (one if d is None else d for d in (dx, dy, dz))
    largest = F.greatest(dx, dy, dz)
    sx, sy, sz = dx / largest, dy / largest, dz / largest
    cx, cy, cz = ((F.col(a) - n / 2.0) * s for a, n, s in (("x", nx, sx), ("y", ny, sy), ("z", nz, sz)))
    x1 = cx * math.cos(rot_y) + cz * math.sin(rot_y)
    z1 = -cx * math.sin(rot_y) + cz * math.cos(rot_y)
    y1 = cy * math.cos(rot_x) - z1 * math.sin(rot_x)
    return half_up(nx / 2.0 + x1 / sx).cast("int"), half_up(ny / 2.0 + y1 / sy).cast("int")


def brightest(points: DataFrame, *keys: str) -> DataFrame:
    """(keys..., px, py, v, n): the greatest value on each pixel of points(keys..., px, py, v), and how many fall on it; NaN is no value."""
    return points.where(~F.isnan(F.col("v").cast("double"))).groupBy(*keys, "px", "py").agg(F.max("v").alias("v"), F.count("*").alias("n"))


def mip(vox: DataFrame, headers: DataFrame, rot_x: float = 0.0, rot_y: float = 0.0) -> DataFrame:
    """(vol_id, px, py, v): the greatest value on each pixel of vox(vol_id, x, y, z, v); headers(vol_id, nx, ny, nz, dx, dy, dz)."""
    with_size = vox.join(headers.select("vol_id", "nx", "ny", "nz", "dx", "dy", "dz"), "vol_id")
    step = F.greatest(F.lit(1), F.floor(F.least("nx", "ny", "nz") / float(MIP_SAMPLES)))
    px, py = mip_pixel(rot_x, rot_y, *(F.col(c) for c in ("nx", "ny", "nz", "dx", "dy", "dz")))
    kept = with_size.where((F.col("x") % step == 0) & (F.col("y") % step == 0) & (F.col("z") % step == 0))
    seen = kept.withColumns({"px": px, "py": py}).where(F.col("px").between(0, F.col("nx") - 1) & F.col("py").between(0, F.col("ny") - 1))
    return brightest(seen, "vol_id").drop("n")


def _projected(volumes: DataFrame, rot_x: float, rot_y: float) -> DataFrame:
    """(vol_id, px, py, v) of every voxel that counts of volumes(vol_id, nx, ny, nz, dx, dy, dz, data); sizes go along with the voxels, without a join."""
    sizes = ("nx", "ny", "nz", "dx", "dy", "dz")
    flat = volumes.select("vol_id", *sizes, F.posexplode(DATA).alias("i", "v"))
    placed = flat.withColumns({"x": F.expr("cast(i % nx as int)"), "y": F.expr("cast(i div nx % ny as int)"), "z": F.expr("cast(i div (nx * ny) as int)")})
    step = F.greatest(F.lit(1), F.floor(F.least("nx", "ny", "nz") / float(MIP_SAMPLES)))
    px, py = mip_pixel(rot_x, rot_y, *(F.col(c) for c in sizes))
    kept = placed.where((F.col("x") % step == 0) & (F.col("y") % step == 0) & (F.col("z") % step == 0)).withColumns({"px": px, "py": py})
    return kept.where(F.col("px").between(0, F.col("nx") - 1) & F.col("py").between(0, F.col("ny") - 1)).select("vol_id", "px", "py", "v")


def volume_mip(volumes: DataFrame, rot_x: float = 0.0, rot_y: float = 0.0, filled: bool = False) -> DataFrame:
    """As :func:`mip`, of volumes at rest that carry their spacing; ``filled``: every pixel, with the volume's least value where nothing falls.

    That value is no greater than any other, so the whole grid of it goes into the same grouped maximum: one shuffle, no join.
    """
    seen = _projected(volumes, rot_x, rot_y)
    if not filled:
        return brightest(seen, "vol_id").drop("n")
    low = array_range(F.col(DATA), widen=False)[0]
    grid = volumes.select("vol_id", "nx", low.alias("v"), F.explode(F.sequence(F.lit(0), (F.col("nx") * F.col("ny") - 1).cast("int"))).alias("p"))
    grid = grid.select("vol_id", F.expr("cast(p % nx as int)").alias("px"), F.expr("cast(p div nx as int)").alias("py"), "v")
    every = seen.withColumn("v", F.col("v").cast("double")).where(~F.isnan("v")).unionByName(grid)
    return every.groupBy("vol_id", "px", "py").agg(F.max("v").alias("v"))


def mip_filled(projected: DataFrame, headers: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every pixel of the projection; those that nothing falls on have the volume's least value."""
    grid = headers.select("vol_id", "nx", F.explode(F.sequence(F.lit(0), (F.col("nx") * F.col("ny") - 1).cast("int"))).alias("p"))
    grid = grid.select("vol_id", F.expr("cast(p % nx as int)").alias("px"), F.expr("cast(p div nx as int)").alias("py"))
    filled = grid.join(projected, ["vol_id", "px", "py"], "left").join(ranges.select("vol_id", "lo"), "vol_id")
    return filled.select("vol_id", "px", "py", F.coalesce(F.col("v").cast("double"), "lo").alias("v"))
