"""Operators on slabs: (vol_id, t, z, nx, ny, nz, data), a row for each axial slice of a volume, as files are read.

A volume never meets in one row, so there is no bound to its size: what an operator needs of a slab is computed where the slab
is, and only small results, bounded samples and bricks of EDGE voxels a side are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .aggregate import CONTRAST_SAMPLES, MIP_SAMPLES, RANGE_SAMPLES
from .bounded import broadcast_within, kept
from .compare import affine_images
from .voxels import AXES, DATA

KEYS = ("vol_id", "t")
SLAB = ("vol_id", "t", "z", "nx", "ny", "nz", DATA)
#: Voxels along each side of a brick.
EDGE = 32
#: Rows, of a few numbers each, up to which a table is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 200_000


def slabs_of(volumes: DataFrame) -> DataFrame:
    """The slabs of volumes at rest (vol_id, nx, ny, nz, data)."""
    size = F.col("nx") * F.col("ny")
    cut = F.transform(F.sequence(F.lit(0), F.col("nz") - 1), lambda z: F.slice(DATA, (z * size + 1).cast("int"), size.cast("int")))
    return volumes.select("vol_id", F.lit(0).alias("t"), "nx", "ny", "nz", F.posexplode(cut).alias("z", DATA)).select(*SLAB)


def of_files(slabs: DataFrame) -> DataFrame:
    """The slabs that the format's view gives; a volume's name is its path."""
    return slabs.withColumnRenamed("path", "vol_id").select(*SLAB)


def _values(column: pa.Array, row: int) -> np.ndarray:
    values = column[row].values
    return np.zeros(0, np.float32) if values is None else values.to_numpy(zero_copy_only=False)


def _mapped(slabs: DataFrame, schema: str, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The slabs' own keys keep their types; the new columns are ``schema``."""
    ship_package(slabs.sparkSession)
    kind = slabs.schema["vol_id"].dataType.simpleString()
    return slabs.mapInArrow(function, f"vol_id {kind}, {schema}")


#: Which voxels a range is of: all; every step-th, so that ``samples`` of a large volume count; those of the three middle slices; of the middle axial one.
RANGE_MODES = ("all", "strided", "middle", "axial")


def _ranged(v: np.ndarray, mode: str, samples: int, z: int, nx: int, ny: int, nz: int) -> np.ndarray:
    """The voxels of a slab that count."""
    if mode == "strided":
        step = max(1, nx * ny * nz // samples)
        return v[(-z * nx * ny) % step :: step]
    if mode == "all" or z == nz // 2:
        return v
    if mode == "axial":
        return v[:0]
    picture = v.reshape(ny, nx)
    return np.concatenate([picture[ny // 2], picture[:, nx // 2]])


def _statistics(samples: int, mode: str = "all", ranged: int = RANGE_SAMPLES):
    """Of each slab the range of its numbers that count, and every step-th voxel of the volume that lies in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            z, nx, ny, nz = (rows.column(k).to_pylist() for k in (2, 3, 4, 5))
            low, high, seen = [], [], []
            for r in range(rows.num_rows):
                v = _values(rows.column(6), r)
                size = nx[r] * ny[r]
                step = max(1, size * nz[r] // samples)
                part = v[(-z[r] * size) % step :: step]
                seen.append(part[~np.isnan(part)].astype(np.float64))
                v = _ranged(v, mode, ranged, z[r], nx[r], ny[r], nz[r])
                v = v[~np.isnan(v)]
                low.append(float(v.min()) if len(v) else None)
                high.append(float(v.max()) if len(v) else None)
            ends = pa.array(np.cumsum([0, *map(len, seen)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*seen, np.zeros(0)])))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(low, pa.float64()), pa.array(high, pa.float64()), lists], ["vol_id", "t", "lo", "hi", "s"])

    return run


def value_range(slabs: DataFrame, widen: bool = True, mode: str = "all", samples: int = RANGE_SAMPLES) -> DataFrame:
    """(vol_id, t, lo, hi) of the voxels that count by ``mode``, one of RANGE_MODES, and are numbers; with ``widen`` a range of one value ends one above it.

    Viewers take different ones of these for the same volume: strided after loading, the middle slices for a preview, the axial one, not widened, for a first look.
    """
    if mode not in RANGE_MODES:
        raise ValueError(f"mode is one of {', '.join(RANGE_MODES)}")
    parts = _mapped(slabs.select(*SLAB), "t int, lo double, hi double, s array<double>", _statistics(1, mode, samples))
    high = F.when(F.min("lo") == F.max("hi"), F.min("lo") + 1).otherwise(F.max("hi")) if widen else F.max("hi")
    return parts.groupBy(*KEYS).agg(F.min("lo").alias("lo"), high.alias("hi"))


def auto_window(slabs: DataFrame, samples: int = CONTRAST_SAMPLES) -> DataFrame:
    """(vol_id, t, p01, p99, win, level), as the operator of this name on volumes at rest, in one pass over the slabs.

    Every step-th voxel counts, between ``samples`` and twice as many of a large volume. Only these meet in a row, however large the volume is.
    NaN is no sample; a volume of nothing else has null statistics.
    """
    parts = _mapped(slabs.select(*SLAB), "t int, lo double, hi double, s array<double>", _statistics(samples))
    found = parts.groupBy(*KEYS).agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def at(p: float) -> Column:
        return F.when(F.size("s") > 0, F.element_at("s", (1 + F.floor(F.size("s") * p)).cast("int")))

    found = found.select(*KEYS, "lo", "hi", at(0.01).alias("p01"), at(0.99).alias("p99"))
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return found.select(*KEYS, "p01", "p99", ((F.col("p99") - F.col("p01")) / span).alias("win"), (((F.col("p01") + F.col("p99")) / 2.0 - F.col("lo")) / span).alias("level"))


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers of 32 bits that are ordered as float32 values are; both zeros are one, NaN are left out."""
    values = values[~np.isnan(values)].astype(np.float32) + np.float32(0)
    bits = values.view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def from_ordered_bits(bits: int) -> float:
    raw = np.array([bits & 0x7FFFFFFF if bits >> 31 else ~bits & 0xFFFFFFFF], np.uint32)
    return float(raw.view(np.float32)[0])


def _histogram(targets: bool):
    """(bin, n) of a slab's values by their upper 16 bits; or, within the bins of its volume's ``targets``, by all bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            where, bins, counts = [], [], []
            for r in range(rows.num_rows):
                bits = ordered_bits(_values(rows.column(2), r))
                if targets:
                    bits = bits[np.isin(bits >> 16, np.array(rows.column(3)[r].as_py(), np.uint32))]
                found, n = np.unique(bits if targets else bits >> 16, return_counts=True)
                where.append(np.full(len(found), r))
                bins.append(found.astype(np.int64))
                counts.append(n)
            at = pa.array(np.concatenate([*where, np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(np.concatenate([*bins, np.zeros(0, np.int64)])), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]))], ["vol_id", "t", "bin", "n"])

    return run


def percentiles(slabs: DataFrame, probabilities: tuple[float, ...]) -> DataFrame:
    """(vol_id, t, p, n, v): the exact order statistics of all n voxels that are numbers, the element at floor(n * p) of the sorted ones.

    Two radix passes: counts by the upper 16 bits of the values find the bin that holds each rank, counts within these bins find the
    value. What is shuffled are counts, at most 65,536 a slab, never voxels. A volume without numbers gives no row.
    """
    slabs = slabs.select(*SLAB)
    line = Window.partitionBy(*KEYS).orderBy("bin")
    upto = F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = _mapped(slabs.select("vol_id", "t", DATA), "t int, bin long, n long", _histogram(False)).groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"))
    ranked = counts.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy(*KEYS))})
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    rank = F.least(F.floor(F.col("total") * F.col("p")), F.col("total") - 1)
    hits = ranked.withColumn("p", wanted).withColumn("rank", rank).where("rank < upto AND rank >= upto - n")
    hits = hits.select(*KEYS, "p", "total", "bin", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rest"))
    hits = kept(hits)
    targets = broadcast_within(kept(hits.groupBy(*KEYS).agg(F.collect_set("bin").alias("bins"))), BROADCAST_ROWS)
    inside = _mapped(slabs.join(targets, list(KEYS)).select("vol_id", "t", DATA, "bins"), "t int, bin long, n long", _histogram(True))
    inside = inside.groupBy(*KEYS, "bin").agg(F.sum("n").alias("n")).withColumn("upper", F.shiftright("bin", 16))
    within = Window.partitionBy(*KEYS, "upper").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.sum("n").over(within))
    found = hits.withColumnRenamed("bin", "upper").join(inside, [*KEYS, "upper"]).where("rest < upto AND rest >= upto - n")
    return _floats(found.select(*KEYS, "p", F.col("total").alias("n"), "bin"))


def _floats(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array([from_ordered_bits(v) for v in b.column(4).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], values], ["vol_id", "t", "p", "n", "v"])

    return _mapped(rows, "t int, p double, n long, v double", run)


def slice_voxels(slabs: DataFrame, axis: str, index: int) -> DataFrame:
    """(vol_id, t, axis, idx, u, w, v): one slice of each volume; none where the index is out of range. Each slab is cut before it is exploded."""
    if axis not in AXES:
        raise ValueError(f"no axis named {axis!r}; there are {', '.join(AXES)}")
    nx, ny = F.col("nx"), F.col("ny")
    if axis == "axial":
        flat = slabs.where(F.col("z") == index).select("vol_id", "t", "nx", F.posexplode(DATA).alias("i", "v"))
        return flat.select("vol_id", "t", F.lit(axis).alias("axis"), F.lit(index).alias("idx"), F.expr("cast(i % nx as int)").alias("u"), F.expr("cast(i div nx as int)").alias("w"), "v")
    if axis == "coronal":
        part, inside = F.slice(DATA, (index * nx + 1).cast("int"), nx.cast("int")), F.lit(index).between(0, ny - 1)
    else:
        part, inside = F.transform(F.sequence(F.lit(0), ny - 1), lambda y: F.try_element_at(F.col(DATA), F.greatest(F.lit(1), y * nx + index + 1).cast("int"))), F.lit(index).between(0, nx - 1)
    return slabs.where(inside).select("vol_id", "t", F.lit(axis).alias("axis"), F.lit(index).alias("idx"), F.col("z").alias("w"), F.posexplode(part).alias("u", "v")).select("vol_id", "t", "axis", "idx", "u", "w", "v")


def preview(slabs: DataFrame) -> DataFrame:
    """(vol_id, t, axis, idx, u, w, v): the middle slice along each axis, in one pass: each slab gives its row and column of two, and the middle one itself."""
    nx, ny, data = F.col("nx"), F.col("ny"), F.col(DATA)
    column = F.transform(F.sequence(F.lit(0), ny - 1), lambda y: F.element_at(data, (y * nx + F.expr("nx div 2") + 1).cast("int")))
    cuts = [
        ("axial", F.expr("nz div 2"), F.when(F.expr("z = nz div 2"), data)),
        ("coronal", F.expr("ny div 2"), F.slice(data, (F.expr("ny div 2") * nx + 1).cast("int"), nx.cast("int"))),
        ("sagittal", F.expr("nx div 2"), column),
    ]
    parts = F.array(*[F.struct(F.lit(a).alias("axis"), k.cast("int").alias("idx"), part.alias("part")) for a, k, part in cuts])
    flat = slabs.select("vol_id", "t", "z", "nx", F.inline(parts)).select("vol_id", "t", "z", "nx", "axis", "idx", F.posexplode("part").alias("i", "v"))
    axial = F.col("axis") == "axial"
    u, w = F.when(axial, F.col("i") % F.col("nx")).otherwise(F.col("i")), F.when(axial, F.expr("cast(i div nx as int)")).otherwise(F.col("z"))
    return flat.select("vol_id", "t", "axis", "idx", u.cast("int").alias("u"), w.cast("int").alias("w"), "v")


#: Points that are looked up together in one slab, about.
PROBED_ROWS = 1 << 16


def probe(slabs: DataFrame, points: DataFrame) -> DataFrame:
    """(vol_id, t, x, y, z, v) at points(vol_id, t, x, y, z); v is null outside the volume. A row for each row of points.

    Points of one slab are put together first, so a slab goes with some thousand of them and not with each; many points of one slab are several groups.
    """
    spread = F.pmod(F.xxhash64("x", "y"), F.lit(max(1, points.count() // PROBED_ROWS)))
    groups = points.groupBy(*KEYS, "z", spread.alias("_s")).agg(F.collect_list(F.struct("x", "y")).alias("_p"))
    x, y = (lambda p, c=c: p[c] for c in "xy")
    inside = lambda p: x(p).between(0, F.col("nx") - 1) & y(p).between(0, F.col("ny") - 1)
    value = lambda p: F.when(inside(p), F.try_element_at(F.col(DATA), F.greatest(F.lit(1), y(p) * F.col("nx") + x(p) + 1).cast("int")))
    found = groups.join(slabs.select(*KEYS, "z", "nx", "ny", DATA), [*KEYS, "z"], "left")
    flat = found.select(*KEYS, "z", F.inline(F.transform("_p", lambda p: F.struct(x(p).alias("x"), y(p).alias("y"), value(p).alias("v")))))
    return flat.select(*KEYS, "x", "y", "z", "v")


def block_sums(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the blocks of 2 x 2, those at the far borders of what is there."""
    out = []
    for a in (sums, counts):
        a = np.pad(a, [(0, n % 2) for n in a.shape])
        out.append(a.reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2).sum(axis=(1, 3)))
    return out[0], out[1]


def pyramid(slabs: DataFrame, levels: int) -> DataFrame:
    """(vol_id, t, z, level, nx, ny, data): each slab as block means by 2**level, all levels from 0 to ``levels`` in one pass.

    A level comes from the sums and counts of the one below. Blocks that a slab doesn't fill are left out, unless a side is shorter than a
    block: then it is one. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            nxs, nys = rows.column(3).to_pylist(), rows.column(4).to_pylist()
            where, sizes, parts = [], [], []
            for r in range(rows.num_rows):
                sums = _values(rows.column(6), r).astype(np.float64).reshape(nys[r], nxs[r])
                counts = np.ones(sums.shape)
                for level in range(levels + 1):
                    if level:
                        sums, counts = block_sums(sums, counts)
                    h, w = (max(1, n >> level) for n in (nys[r], nxs[r]))
                    where.append(r)
                    sizes.append((level, w, h))
                    parts.append((sums[:h, :w] / counts[:h, :w]).astype(np.float32).ravel())
            at = pa.array(where, pa.int64())
            data = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.float32)])))
            yield pa.RecordBatch.from_arrays([*(rows.column(k).take(at) for k in (0, 1, 2)), *(pa.array([s[k] for s in sizes], pa.int32()) for k in range(3)), data], ["vol_id", "t", "z", "level", "nx", "ny", DATA])

    return _mapped(slabs.select(*SLAB), "t int, z int, level int, nx int, ny int, data array<float>", run)


def projection(slabs: DataFrame, headers: DataFrame, rot_x: float = 0.0, rot_y: float = 0.0) -> DataFrame:
    """(vol_id, t, px, py, v): the greatest value on each pixel under a rotation, as ``aggregate.mip`` of single voxels.

    headers(vol_id, dx, dy, dz). Of a large volume every step-th slab, row and column counts; the others are left out before anything is
    computed. A task keeps one picture of the volume at hand and gives its pixels, so pixels are shuffled and not voxels.
    """
    step = F.greatest(F.lit(1), F.floor(F.least("nx", "ny", "nz") / float(MIP_SAMPLES))).cast("int")
    # A row for each volume; slabs stay where they are unless there are very many.
    spacing = broadcast_within(kept(headers.select("vol_id", "dx", "dy", "dz")), BROADCAST_ROWS)
    used = slabs.withColumn("step", step).where("z % step = 0").join(spacing, "vol_id")
    sin_x, cos_x, sin_y, cos_y = math.sin(rot_x), math.cos(rot_x), math.sin(rot_y), math.cos(rot_y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, picture = None, None

        def pixels() -> pa.RecordBatch:
            py, px = np.nonzero(~np.isnan(picture))
            n = len(px)
            return pa.RecordBatch.from_arrays([pa.repeat(held[0], n), pa.repeat(held[1], n), pa.array(px.astype(np.int32)), pa.array(py.astype(np.int32)), pa.array(picture[py, px])], ["vol_id", "t", "px", "py", "v"])

        for rows in batches:
            columns = [rows.column(k).to_pylist() for k in range(2, 10)]
            for r in range(rows.num_rows):
                z, nx, ny, nz, every, dx, dy, dz = (c[r] for c in columns)
                key = (rows.column(0)[r], rows.column(1)[r])
                if key != held:
                    if held is not None:
                        yield pixels()
                    held, picture = key, np.full((ny, nx), np.nan, np.float32)
                largest = max(dx, dy, dz)
                sx, sy, sz = dx / largest, dy / largest, dz / largest
                v = _values(rows.column(10), r).reshape(ny, nx)[::every, ::every].ravel()
                y, x = (a.ravel() for a in np.meshgrid(np.arange(0, ny, every), np.arange(0, nx, every), indexing="ij"))
                cx, cy, cz = (x - nx / 2.0) * sx, (y - ny / 2.0) * sy, (z - nz / 2.0) * sz
                x1, z1 = cx * cos_y + cz * sin_y, -cx * sin_y + cz * cos_y
                y1 = cy * cos_x - z1 * sin_x
                px = np.floor(nx / 2.0 + x1 / sx + 0.5).astype(np.int64)
                py = np.floor(ny / 2.0 + y1 / sy + 0.5).astype(np.int64)
                seen = (px >= 0) & (px < nx) & (py >= 0) & (py < ny) & ~np.isnan(v)
                np.fmax.at(picture, (py[seen], px[seen]), v[seen])
        if held is not None:
            yield pixels()

    drawn = _mapped(used.select("vol_id", "t", "z", "nx", "ny", "nz", "step", "dx", "dy", "dz", DATA), "t int, px int, py int, v float", run)
    return drawn.groupBy(*KEYS, "px", "py").agg(F.max("v").alias("v"))


def pictures(projected: DataFrame, sizes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(vol_id, t, nx, ny, data): the projection of each volume of sizes(vol_id, nx, ny) as one array, row by row; pixels that nothing falls on have
    the volume's least value, of ranges(vol_id, t, lo). A row is as large as one picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for r, (nx, ny, lo) in enumerate(zip(*(rows.column(k).to_pylist() for k in (2, 3, 4)))):
                data = np.full(nx * ny, np.nan if lo is None else lo, np.float64)
                pixels = rows.column(5)[r].values
                if pixels is not None:
                    px, py, v = (pixels.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    data[py * nx + px] = v
                out.append(data)
            ends = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out)))], ["vol_id", "t", "nx", "ny", DATA])

    drawn = projected.groupBy(*KEYS).agg(F.collect_list(F.struct("px", "py", "v")).alias("pixels"))
    whole = ranges.select(*KEYS, "lo").join(sizes.select("vol_id", "nx", "ny"), "vol_id").join(drawn, list(KEYS), "left")
    return _mapped(whole.select(*KEYS, "nx", "ny", "lo", "pixels"), "t int, nx int, ny int, data array<double>", run)


def _bricks_of(edge: int):
    """Squares of ``edge`` a side of each slab, by the brick that they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            zs, nxs, nys = (rows.column(k).to_pylist() for k in (2, 3, 4))
            where, places, parts = [], [], []
            for r in range(rows.num_rows):
                picture = _values(rows.column(6), r).reshape(nys[r], nxs[r])
                for y in range(0, nys[r], edge):
                    for x in range(0, nxs[r], edge):
                        where.append(r)
                        places.append((x // edge, y // edge, zs[r] // edge, zs[r]))
                        parts.append(picture[y : y + edge, x : x + edge].ravel())
            at = pa.array(where, pa.int64())
            data = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.float32)])))
            sizes = [rows.column(k).take(at) for k in (0, 1, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([*sizes, *(pa.array([p[k] for p in places], pa.int32()) for k in range(4)), data], ["vol_id", "t", "nx", "ny", "nz", "bx", "by", "bz", "z", DATA])

    return run


BRICK = ("bx", "by", "bz")


def bricks(slabs: DataFrame, edge: int = EDGE) -> DataFrame:
    """(vol_id, t, nx, ny, nz, bx, by, bz, data): volumes cut into cubes of ``edge`` voxels a side, smaller ones at the far borders, x fastest."""
    squares = _mapped(slabs.select(*SLAB), "t int, nx int, ny int, nz int, bx int, by int, bz int, z int, data array<float>", _bricks_of(edge))
    data = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("z", DATA))), lambda s: s[DATA]))
    # Sides are alike within a volume; grouped by the brick alone, bricks lie as the joins on them need.
    return squares.groupBy(*KEYS, *BRICK).agg(*[F.max(n).alias(n) for n in ("nx", "ny", "nz")], data.alias(DATA))


def _box(places: list[int], sides: list[int], edge: int) -> tuple[list[int], list[int]]:
    """First voxel and size of a brick along x, y and z."""
    first = [p * edge for p in places]
    return first, [min(edge, n - f) for f, n in zip(first, sides)]


def mapped_places(image: np.ndarray, first: list[int], size: list[int]) -> np.ndarray:
    """The other volume's voxels, rounded, for all voxels of a box, x fastest; ``image`` holds the images of the origin and of the three steps."""
    z, y, x = (a.ravel() for a in np.meshgrid(*(np.arange(f, f + n) for f, n in zip(first[::-1], size[::-1])), indexing="ij"))
    return np.floor(image[0][:, None] + (image[1:] - image[0]).T @ np.stack([x, y, z]).astype(float) + 0.5)


def _looked_up(edge: int):
    """Of a pair of bricks the voxels of the first whose image lies in the second, with their values there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for r in range(rows.num_rows):
                row = [rows.column(k)[r].as_py() for k in range(2, 15)]
                first, size = _box(row[0:3], row[6:9], edge)
                other_first, other_size = _box(row[3:6], row[9:12], edge)
                b = mapped_places(np.array(row[12], float).reshape(4, 3), first, size) - np.array(other_first)[:, None]
                at = np.flatnonzero(np.logical_and.reduce([(b[k] >= 0) & (b[k] < other_size[k]) for k in range(3)]))
                c = b[:, at].astype(np.int64)
                out.append((at.astype(np.int32), _values(rows.column(15), r)[c[0] + other_size[0] * (c[1] + other_size[1] * c[2])]))
            ends = pa.array(np.cumsum([0, *[len(a) for a, _ in out]]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], *lists], ["vol_id", "t", "bx", "by", "bz", "at", "other"])

    return run


def _assembled(edge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            others = []
            for r in range(rows.num_rows):
                at = rows.column(7)[r].values
                values = np.full(len(_values(rows.column(5), r)), np.nan, np.float32)
                known = np.zeros(len(values), bool)
                if at is not None:
                    at = at.to_numpy(zero_copy_only=False)
                    values[at], known[at] = _values(rows.column(8), r), True
                others.append(pa.array(values, mask=~known))
            ends = pa.array(np.cumsum([0, *map(len, others)]), pa.int32())
            first = [pa.array(np.array(rows.column(k).to_pylist(), np.int64) * edge, pa.int32()) for k in (2, 3, 4)]
            sides = rows.column(6).to_pylist()
            size = [pa.array([min(edge, s[k] - f) for s, f in zip(sides, first[k].to_pylist())], pa.int32()) for k in range(3)]
            columns = [rows.column(0), rows.column(1), *first, *size, rows.column(5), pa.ListArray.from_arrays(ends, pa.concat_arrays(others))]
            yield pa.RecordBatch.from_arrays(columns, ["vol_id", "t", "x0", "y0", "z0", "w", "h", "d", DATA, "other"])

    return run


def compare(slabs: DataFrame, header: DataFrame, others: DataFrame, other_header: DataFrame, edge: int = EDGE) -> DataFrame:
    """Each voxel of ``slabs`` with the value of ``others``, alike, at its world point, in bricks: (vol_id, t, x0, y0, z0, w, h, d, data, other).

    The volumes that are compared have one vol_id, headers(vol_id, nx, ny, nz, and the affine's columns) too; a brick begins at (x0, y0, z0)
    and has w x h x d voxels; ``other`` is null where the point lies outside the other volume.

    A spatial join of blocks: the affine image of a brick's corners says which of the other volume's bricks it may meet, a few whatever the
    turn between them, and (volume, brick) is an equi-join. One brick of each is looked up at a time, and what is found is put
    into the first one's place, so no row is larger than three bricks. The voxels of either volume are shuffled once as bricks, those found once more.
    """
    named = other_header.select("vol_id", *[F.col(c).alias(f"b_{c}") for c in other_header.columns if c != "vol_id"])
    both = header.join(named, "vol_id").withColumn("images", affine_images())
    count = [F.ceil(F.col(n) / edge).cast("int") for n in ("nx", "ny", "nz")]
    for place, n in zip(BRICK, count):
        both = both.withColumn(place, F.explode(F.sequence(F.lit(0), n - 1)))
    # Images of a brick's corners: the affine map takes its least and greatest values there. Rounding may add one voxel on either side.
    reach = {}
    for k, n in enumerate(("b_nx", "b_ny", "b_nz")):
        step = lambda j: F.element_at("images", 3 * (j + 1) + k + 1) - F.element_at("images", k + 1)  # noqa: E731, B023
        low = high = F.element_at("images", k + 1)
        for j, (place, side) in enumerate(zip(BRICK, ("nx", "ny", "nz"))):
            ends = [step(j) * (F.col(place) * edge), step(j) * (F.least((F.col(place) + 1) * edge, F.col(side)) - 1)]
            low, high = low + F.least(*ends), high + F.greatest(*ends)
        last = F.ceil(F.col(n) / edge) - 1
        reach[k] = (F.greatest(F.lit(0), F.floor((F.floor(low + 0.5) - 1) / edge)).cast("int"), F.least(last, F.floor((F.floor(high + 0.5) + 1) / edge)).cast("int"))
    for k, (low, high) in reach.items():
        both = both.withColumns({f"low{k}": low, f"high{k}": high})
    both = both.where(" AND ".join(f"low{k} <= high{k}" for k in reach))
    for k in reach:
        both = both.withColumn(f"o{'xyz'[k]}", F.explode(F.sequence(f"low{k}", f"high{k}")))
    theirs = bricks(others, edge).select("vol_id", "t", *[F.col(b).alias(f"o{a}") for a, b in zip("xyz", BRICK)], F.col(DATA).alias("theirs"))
    meeting = both.join(theirs, ["vol_id", "ox", "oy", "oz"])
    meeting = meeting.select("vol_id", "t", *BRICK, "ox", "oy", "oz", "nx", "ny", "nz", "b_nx", "b_ny", "b_nz", "images", "theirs")
    found = _mapped(meeting, "t int, bx int, by int, bz int, at array<int>, other array<float>", _looked_up(edge))
    found = found.groupBy(*KEYS, *BRICK).agg(F.flatten(F.collect_list(F.arrays_zip("at", "other"))).alias("found"))
    found = found.select(*KEYS, *BRICK, F.transform("found", lambda f: f["at"]).alias("at"), F.transform("found", lambda f: f["other"]).alias("other"))
    mine = bricks(slabs, edge).withColumn("sides", F.array("nx", "ny", "nz"))
    return _mapped(mine.join(found, [*KEYS, *BRICK], "left").select(*KEYS, *BRICK, DATA, "sides", "at", "other"), "t int, x0 int, y0 int, z0 int, w int, h int, d int, data array<float>, other array<float>", _assembled(edge))


def brick_voxels(compared: DataFrame) -> DataFrame:
    """(vol_id, t, x, y, z, v, other) of what :func:`compare` returns."""
    flat = compared.select("vol_id", "t", "x0", "y0", "z0", "w", "h", F.posexplode(F.arrays_zip(DATA, "other")).alias("i", "p"))
    place = [("x0 + i % w", "x"), ("y0 + (i div w) % h", "y"), ("z0 + i div (w * h)", "z")]
    return flat.select("vol_id", "t", *[F.expr(f"cast({e} as int)").alias(a) for e, a in place], F.col(f"p.{DATA}").alias("v"), F.col("p.other").alias("other"))
