"""``spark.read.format("nifti")``: headers and voxels of NIfTI files, plain or gzipped, single or as pairs of .hdr and .img.

A view ``header`` reads the first bytes of each file. A view ``slabs`` has a row for each (file, frame, z)
with the slab's voxels as an array; a view ``voxels`` one for each voxel. Paths are local or any URI that
Arrow's file systems open (s3, gs, hdfs, abfs, file), and http or https, which are read by byte range.

Planning lists files and opens none. A plain file is divided by its size into parts of about ``slabBytes``, so a
large volume is read by many tasks, each of its own bytes; small files share a task. A gzipped file can't be
entered in the middle and is one part, which stops inflating behind the last slab it needs. Options ``z`` and ``t``, and in the view
of voxels ``x`` and ``y``, ``"40"`` or ``"10:20"`` (before 20), bound what is read: they cut the byte ranges.

With option ``pushdown`` filters on these columns (equal, less, greater, in) are taken over as bounds too. It needs
spark.sql.python.filterPushdown.enabled and is off by default: Spark 4.1 keeps one reader for each DataFrame, and where
such a DataFrame is scanned twice in a query with different filters, as in a union or a self-join, the last one's filters hold
for both scans and rows are lost. With it on, load the format once for each scan.

Option ``damaged`` says what happens to a file that is cut short, corrupt, no NIfTI file, of colours, or a .hdr without its .img:
``fail``, the default, ends the job; ``skip`` leaves the file out; ``report`` gives it one row, with what is wrong in a
column ``error`` that the views then have. No value is ever made up. To know before the first row that a gzipped file is whole, ``skip``
and ``report`` inflate it twice; ``fail`` verifies its checksum when the last slab has been read. ``padShort`` reads what a
plain file lacks as zeros instead.

Frames are numbered by the fourth and fifth dimension, t + nt * u.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..session import ship_package
from .nifti_header import PREFIX_BYTES, SCHEMA, parse_header
from .volume_files import Inflated, Plain, Ranged, Unreadable, exists, is_gzip, listed, opened

SLAB_BYTES = 32 << 20
#: Voxels that one Arrow batch holds, about, and files that share a task at the most.
BATCH_VOXELS, TASK_FILES = 1 << 20, 1000
#: Tasks of one scan at the most; beyond that each has several parts.
TASKS = 100_000
#: Bytes between two runs of wanted voxels that are read along rather than skipped, and bytes of one read at the most.
MERGED_BYTES, READ_BYTES = 4096, 8 << 20

# Numpy types of the element codes that are numbers.
DTYPES = {1: "u1", 2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}

VIEWS = {
    "header": f"path string, {SCHEMA}, error string",
    "slabs": "path string, t int, z int, nx int, ny int, nz int, data array<float>",
    "voxels": "path string, t int, x int, y int, z int, v float",
}
PATTERNS = ("*.nii", "*.nii.gz", "*.hdr", "*.hdr.gz")
DAMAGED = ("fail", "skip", "report")
_ALL = (0, 1 << 40)


def frames(h: dict) -> int:
    """Volumes in a file, by its fourth and fifth dimension."""
    return h["nt"] * h.get("nu", 1)


class Parts(InputPartition):
    """Files (path, part, parts) that one task reads: of each the part-th of so many equal parts of its slabs within the bounds of z and t."""

    def __init__(self, files: list[tuple[str, int, int]], z: tuple[int, int], t: tuple[int, int]):
        self.files, self.z, self.t = files, z, t

    def ranges(self, h: dict, part: int, parts: int) -> list[tuple[int, int, int]]:
        """The slabs of one part of a file, (t, low, high): those within the bounds, in their order, dealt into equal parts."""
        low, high = max(0, self.z[0]), min(h["nz"], self.z[1])
        first, last = max(0, self.t[0]), min(frames(h), self.t[1])
        if low >= high or first >= last:
            return []
        depth = high - low
        total = depth * (last - first)
        begin, end = part * total // parts, (part + 1) * total // parts
        return [(first + k, low + max(0, begin - k * depth), low + min(depth, end - k * depth)) for k in range(begin // depth, -(-end // depth)) if begin < end]


def image_path(path: str) -> str | None:
    """The file of voxels that belongs to a .hdr, gzipped or not as there is one; none for other names."""
    stem = path.removesuffix(".gz")
    if not stem.endswith(".hdr"):
        return None
    return next((p for p in (stem[:-4] + ".img", stem[:-4] + ".img.gz") if exists(p)), None)


def volumes_listed(path: str, *patterns: str) -> list[tuple[str, int]]:
    """As ``listed``, of volumes: a .hdr has the size of its .img, so that a large one is read in parts; one beside which there is no plain .img keeps its own."""
    found = listed(path, *patterns, "*.img")
    images = {p: s for p, s in found if p.endswith(".img") and p != path}
    out = []
    for name, size in found:
        if name in images:
            continue
        stem = name.removesuffix(".gz")
        if stem.endswith(".hdr"):
            image = stem[:-4] + ".img"
            if image not in images and name == path and exists(image):
                images |= dict(listed(image))
            size = images.get(image, size)
        out.append((name, size))
    return out


def header_path(path: str) -> str:
    """The file that holds the header of what is asked for: for an .img its .hdr."""
    stem = path.removesuffix(".gz")
    if not stem.endswith(".img"):
        return path
    found = next((p for p in (stem[:-4] + ".hdr", stem[:-4] + ".hdr.gz") if exists(p)), None)
    if found is None:
        raise Unreadable("there is no .hdr beside this .img")
    return found


def read_header(path: str, mode: str = "standard") -> dict:
    path = header_path(path)
    source = opened(path)
    try:
        return parse_header(source.read(0, PREFIX_BYTES), is_gzip(path), mode)
    finally:
        source.close()


def _numeric(h: dict) -> dict:
    if h["datatype"] not in DTYPES:
        raise Unreadable(f"voxels of type {h['datatype']} aren't numbers that can be decoded")
    return h


def open_volume(path: str, mode: str = "standard") -> tuple[Inflated | Plain | Ranged, dict]:
    """What the voxels are read from, and the header; Unreadable if there are none."""
    path = header_path(path)
    source = opened(path)
    try:
        h = _numeric(parse_header(source.read(0, PREFIX_BYTES), is_gzip(path), mode))
        if h["paired"]:
            image = image_path(path)
            if image is None:
                raise Unreadable("its header says that voxels are in an .img file, and there is none beside it")
            source.close()
            source = opened(image)
        return source, h
    except BaseException:
        source.close()
        raise


def end_of_voxels(h: dict) -> int:
    return h["vox_offset"] + frames(h) * h["volume_bytes"]


def decode(raw: bytes, header: dict, count: int) -> np.ndarray:
    """``count`` rescaled voxels as float32; those beyond the end of the bytes are zero before rescaling."""
    code = header["datatype"]
    if code not in DTYPES:
        raise ValueError(f"voxels of type {code} aren't numbers that can be decoded")
    dtype = np.dtype(("<" if header["little_endian"] else ">") + DTYPES[code])
    have = len(raw) // dtype.itemsize
    values = np.zeros(count, np.float64)
    values[:have] = np.frombuffer(raw, dtype, have)
    slope, inter = header["scl_slope"], header["scl_inter"]
    if slope != 1 or inter != 0:
        values = values * slope + inter
    return values.astype(np.float32)


class Rows:
    """Rows of a view, gathered into Arrow batches of about BATCH_VOXELS; with ``report`` they have a column for what is wrong."""

    def __init__(self, view: str, report: bool = False):
        self.view, self.report = view, report
        self.clear()

    def clear(self) -> None:
        self.pieces: list[tuple] = []
        self.held = 0

    def add(self, path: str, h: dict, t: int, z: int, cube: np.ndarray, y: int = 0, x: int = 0) -> bool:
        """Take up a cube (slabs, rows, columns) that begins at (t, z, y, x); true when there is enough for a batch."""
        self.pieces.append((path, h, t, z, cube, y, x, None))
        self.held += cube.size
        return self.held >= BATCH_VOXELS

    def damaged(self, path: str, error: str) -> None:
        self.pieces.append((path, None, 0, 0, np.zeros((1, 1, 1), np.float32), 0, 0, error))

    def batch(self) -> pa.RecordBatch:
        counts = [p[4].shape[0] if self.view == "slabs" else p[4].size for p in self.pieces]
        where = pa.array(np.repeat(np.arange(len(counts)), counts))
        wrong = pa.array([p[7] for p in self.pieces], pa.string()).take(where)
        good = wrong.is_null()
        values = np.concatenate([p[4].ravel() for p in self.pieces])
        columns = {"path": pa.array([p[0] for p in self.pieces]).take(where)}
        numbers = self._slabs() if self.view == "slabs" else self._voxels()
        columns |= {c: pa.array(np.concatenate(n).astype(np.int32)) for c, n in numbers.items()}
        if self.view == "slabs":
            sizes = np.concatenate([np.full(p[4].shape[0], p[4][0].size) for p in self.pieces])
            columns["data"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))
        else:
            columns["v"] = pa.array(values)
        if self.report:
            columns = {c: v if c == "path" else _only(good, v) for c, v in columns.items()} | {"error": wrong}
        self.clear()
        return pa.RecordBatch.from_pydict(columns)

    def _slabs(self) -> dict[str, list[np.ndarray]]:
        out: dict[str, list] = {c: [] for c in ("t", "z", "nx", "ny", "nz")}
        for _, h, t, z, cube, _, _, _ in self.pieces:
            n = cube.shape[0]
            for c, v in (("t", t), ("nx", h and h["nx"]), ("ny", h and h["ny"]), ("nz", h and h["nz"])):
                out[c].append(np.full(n, v or 0))
            out["z"].append(np.arange(z, z + n))
        return out

    def _voxels(self) -> dict[str, list[np.ndarray]]:
        out: dict[str, list] = {c: [] for c in ("t", "x", "y", "z")}
        for _, _, t, z, cube, y, x, _ in self.pieces:
            k = np.indices(cube.shape, np.int32).reshape(3, -1)
            for c, v in (("t", np.full(cube.size, t)), ("x", k[2] + x), ("y", k[1] + y), ("z", k[0] + z)):
                out[c].append(v)
        return out


def _only(good: pa.Array, values: pa.Array) -> pa.Array:
    """Null where a row is not good."""
    return pa.compute.if_else(good, values, pa.scalar(None, values.type))


def runs_of_slabs(h: dict, ranges: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(t, z, slabs, start, size) of the reads that ranges (t, low, high) of slabs take, each of a batch's voxels at the most."""
    step = max(1, BATCH_VOXELS // max(1, h["slice_size"]))
    size = h["slice_size"] * h["bytes_per_voxel"]
    for t, low, high in ranges:
        for z in range(low, high, step):
            count = min(step, high - z)
            yield t, z, count, h["vox_offset"] + t * h["volume_bytes"] + z * size, size * count


def byte_runs(starts: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, start, bytes): how rows first..last-1 of ``size`` bytes each are read, near ones by one read."""
    if not len(starts):
        return
    apart = np.diff(starts) - size > MERGED_BYTES
    apart |= np.diff((starts - starts[0]) // READ_BYTES) > 0
    cut = [0, *(np.flatnonzero(apart) + 1).tolist(), len(starts)]
    for first, last in zip(cut[:-1], cut[1:]):
        yield first, last, int(starts[first]), int(starts[last - 1]) + size - int(starts[first])


class Scan:
    """How a view is read: its options and what the filters leave; sent to the tasks."""

    def __init__(self, view: str, mode: str = "standard", damaged: str = "fail", pad: bool = False):
        if view not in VIEWS:
            raise ValueError(f"view is one of {', '.join(VIEWS)}")
        if damaged not in DAMAGED:
            raise ValueError(f"damaged is one of {', '.join(DAMAGED)}")
        self.view, self.mode, self.damaged, self.pad = view, mode, damaged, pad
        self.bounds = dict.fromkeys("ztxy", _ALL)

    def within(self, name: str, low: int, high: int) -> None:
        """Narrow the bounds of an axis to low..high-1."""
        if name not in self.taken:
            raise ValueError(f"the view {self.view} has no bounds of {name}")
        self.bounds[name] = (max(self.bounds[name][0], low), min(self.bounds[name][1], high))

    @property
    def taken(self) -> str:
        """Columns that can be bounded."""
        return {"voxels": "ztxy", "slabs": "zt"}.get(self.view, "")

    @property
    def schema(self) -> str:
        return VIEWS[self.view] + (", error string" if self.damaged == "report" and self.view != "header" else "")

    def read(self, files: Iterable[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        """Rows of (path, part, parts)."""
        rows, parts = Rows(self.view, self.damaged == "report"), Parts([], self.bounds["z"], self.bounds["t"])
        for path, part, number in files:
            try:
                source, h = open_volume(path, self.mode)
                try:
                    checked = self._check(source, h)
                    ranges = parts.ranges(h, part, number)
                    for piece in self.cubes(source, h, ranges):
                        if rows.add(path, h, *piece):
                            yield rows.batch()
                    if not checked and ranges and ranges[-1][0] == frames(h) - 1 and ranges[-1][2] == h["nz"]:
                        source.verify(end_of_voxels(h))
                finally:
                    source.close()
            except Unreadable as e:
                if self.damaged == "fail":
                    raise Unreadable(f"{path}: {e}") from e
                if self.damaged == "report" and part == 0:
                    rows.damaged(path, str(e))
        if rows.pieces:
            yield rows.batch()

    def _check(self, source: Inflated | Plain | Ranged, h: dict) -> bool:
        """Whether the file is known to be whole. A gzipped one is inflated for that only if its rows may not be given before."""
        if self.pad and not isinstance(source, Inflated):
            return True
        if isinstance(source, Inflated) and self.damaged == "fail":
            return False
        source.verify(end_of_voxels(h))
        return True

    def cubes(self, source: Inflated | Plain | Ranged, h: dict, ranges: list[tuple[int, int, int]]) -> Iterator[tuple]:
        """(t, z, cube, y, x) of the voxels within the bounds."""
        (x0, x1), (y0, y1) = ((max(0, low), min(h[n], high)) for (low, high), n in ((self.bounds["x"], "nx"), (self.bounds["y"], "ny")))
        if x0 >= x1 or y0 >= y1:
            return
        nx, ny, width = h["nx"], h["ny"], h["bytes_per_voxel"]
        if (x1 - x0, y1 - y0) == (nx, ny):
            for t, z, count, start, size in runs_of_slabs(h, ranges):
                yield t, z, decode(self._bytes(source, start, size), h, size // width).reshape(count, ny, nx), 0, 0
            return
        step = max(1, BATCH_VOXELS // ((x1 - x0) * (y1 - y0)))
        for t, low, high in ranges:
            for z in range(low, high, step):
                depth = min(step, high - z)
                place = (np.arange(z, z + depth)[:, None] * ny + np.arange(y0, y1)).ravel() * nx + x0
                starts = h["vox_offset"] + t * h["volume_bytes"] + place * width
                cube = np.empty((len(starts), x1 - x0), np.float32)
                for first, last, start, size in byte_runs(starts, (x1 - x0) * width):
                    values = decode(self._bytes(source, start, size), h, size // width)
                    cube[first:last] = values[((starts[first:last] - start) // width)[:, None] + np.arange(x1 - x0)]
                yield t, z, cube.reshape(depth, y1 - y0, x1 - x0), y0, x0

    def _bytes(self, source: Inflated | Plain | Ranged, start: int, size: int) -> bytes:
        raw = source.read(start, size)
        if len(raw) < size and not (self.pad and not isinstance(source, Inflated)):
            raise Unreadable(f"it ends {size - len(raw)} bytes before those at {start + size}")
        return raw

    def headers(self, paths: Iterable[str]) -> Iterator[tuple]:
        """Rows of the header view; a file that has none has an error and null fields."""
        for path in paths:
            try:
                yield (path, *read_header(path, self.mode).values(), None)
            except (Unreadable, OSError, EOFError) as e:
                yield (path, *[None] * len(SCHEMA.split(", ")), str(e))


def scan_of(options: dict) -> Scan:
    scan = Scan(options.get("view", "voxels").lower(), options.get("mode", "standard"), options.get("damaged", "fail").lower(), options.get("padshort", "false").lower() == "true")
    for name in "ztxy":
        if options.get(name):
            low, colon, high = options[name].partition(":")
            scan.within(name, int(low or 0), int(high) if high else _ALL[1] if colon else int(low) + 1)
    return scan


class BoundedReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.scan = scan_of(options)
        self.bounds = self.scan.bounds
        self.slab_bytes = int(options.get("slabbytes", SLAB_BYTES))
        self.patterns = [options["pathglobfilter"]] if options.get("pathglobfilter") else PATTERNS
        self.asked = json.loads(options["paths"]) if options.get("paths") else [options.get("path") or ""]

    def partitions(self) -> list[Parts]:
        return partitioned([f for name in self.asked for f in volumes_listed(name, *self.patterns)], self.scan, self.slab_bytes)

    def read(self, partition: Parts) -> Iterator:
        if self.scan.view == "header":
            return self.scan.headers(path for path, _, _ in partition.files)
        return self.scan.read(partition.files)


class NiftiReader(BoundedReader):
    """Takes filters over as bounds; see the module's text for what that asks of the caller."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        # A row that reports an error has no coordinates, so there Spark filters.
        taken = "" if self.scan.damaged == "report" else self.scan.taken
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else ""
            if name and name in taken and isinstance(getattr(f, "value", None), (int, tuple, list)):
                low, high = self.bounds[name]
                if isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    low = max(low, f.value)
                elif isinstance(f, GreaterThan):
                    low = max(low, f.value + 1)
                elif isinstance(f, LessThanOrEqual):
                    high = min(high, f.value + 1)
                elif isinstance(f, LessThan):
                    high = min(high, f.value)
                else:
                    if isinstance(f, In) and f.value:
                        self.bounds[name] = (max(low, min(f.value)), min(high, max(f.value) + 1))
                    yield f
                    continue
                self.bounds[name] = (low, high)
            else:
                yield f


def partitioned(files: list[tuple[str, int]], scan: Scan, slab_bytes: int) -> list[Parts]:
    """(path, size) dealt to tasks: large plain files in parts, small ones together."""
    out, small, held = [], [], 0
    # A file has no more parts than slabs that the filters leave.
    (z0, z1), (t0, t1) = scan.bounds["z"], scan.bounds["t"]
    most = max(0, z1 - z0) * max(0, t1 - t0) if scan.view != "header" else 1
    for path, size in files:
        # A gzipped header may have a plain file of voxels.
        parts = 1 if is_gzip(path) and not path.endswith(".hdr.gz") else min(-(-size // slab_bytes), most)
        if parts > 1:
            out += [Parts([(path, part, parts)], (z0, z1), (t0, t1)) for part in range(parts)]
        elif most:
            share = PREFIX_BYTES if scan.view == "header" else size
            if small and (held + share > slab_bytes or len(small) >= TASK_FILES):
                out.append(Parts(small, (z0, z1), (t0, t1)))
                small, held = [], 0
            small = [*small, (path, 0, 1)]
            held += share
    return out + ([Parts(small, (z0, z1), (t0, t1))] if small or not out else [])


class NiftiDataSource(DataSource):
    """Options: path (file, folder or pattern), view, mode, damaged, padShort, z, t, x, y, pushdown, slabBytes, pathGlobFilter; for writing see :mod:`nifti_sink`."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return scan_of(self.options).schema

    def reader(self, schema) -> BoundedReader:
        return (NiftiReader if self.options.get("pushdown", "false").lower() == "true" else BoundedReader)(schema, self.options)

    def writer(self, schema, overwrite: bool):
        from .nifti_sink import NiftiWriter

        return NiftiWriter(schema, self.options, overwrite)

    def streamReader(self, schema):
        from .nifti_stream import NiftiStreamReader

        return NiftiStreamReader(schema, self.options)


def decoded_content(raw: bytes | None, mode: str = "standard") -> Iterator[tuple[dict, int, int, np.ndarray]]:
    """(header, t, z, cube) of a file's bytes, gzipped or not; Unreadable before the first of them if they aren't a whole file."""
    raw = raw or b""
    zipped = raw[:2] == b"\x1f\x8b"
    try:
        raw = gzip.decompress(raw) if zipped else raw
    except (OSError, EOFError, zlib.error) as e:
        raise Unreadable(f"gzip: {e}") from e
    h = _numeric(parse_header(raw[:PREFIX_BYTES], zipped, mode))
    if h["paired"]:
        raise Unreadable("its header says that voxels are in an .img file")
    if len(raw) < end_of_voxels(h):
        raise Unreadable(f"it has {len(raw)} bytes of {end_of_voxels(h)}")
    for t, z, count, start, size in runs_of_slabs(h, [(t, 0, h["nz"]) for t in range(frames(h))]):
        yield h, t, z, decode(raw[start : start + size], h, count * h["slice_size"]).reshape(count, h["ny"], h["nx"])


def decode_files(files: DataFrame, mode: str = "standard", damaged: str = "fail") -> DataFrame:
    """The ``slabs`` view of files(path, content), such as ``binaryFile`` reads from any store; gzipped content is inflated.

    ``damaged`` is as for the format: content that is no whole NIfTI file of numbers, null or empty too, ends the job, gives no row, or one with its error.
    """
    ship_package(files.sparkSession)
    scan = Scan("slabs", mode, damaged)

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows("slabs", damaged == "report")
        for files_ in batches:
            for path, raw in zip(files_.column(0).to_pylist(), files_.column(1)):
                try:
                    for h, t, z, cube in decoded_content(raw.as_py(), mode):
                        if rows.add(path, h, t, z, cube):
                            yield rows.batch()
                except Unreadable as e:
                    if damaged == "fail":
                        raise Unreadable(f"{path}: {e}") from e
                    if damaged == "report":
                        rows.damaged(path, str(e))
        if rows.pieces:
            yield rows.batch()

    return files.select("path", "content").mapInArrow(slabs, scan.schema)


def write_files(volumes: DataFrame, folder: str) -> None:
    """Write volumes(name, nx, ny, nz, datatype, order, scl_slope, scl_inter, data) as NIfTI files in ``folder``, one each; see :mod:`nifti_sink`."""
    register(volumes.sparkSession)
    volumes.write.format("nifti").mode("append").save(folder)


def slab_voxels(slabs: DataFrame) -> DataFrame:
    """(path, t, x, y, z, v) of the ``slabs`` view."""
    flat = slabs.select("path", "t", "z", "nx", F.posexplode("data").alias("i", "v"))
    return flat.select("path", "t", F.expr("cast(i % nx as int)").alias("x"), F.expr("cast(i div nx as int)").alias("y"), "z", "v")


def as_volumes(slabs: DataFrame) -> DataFrame:
    """(vol_id, t, nx, ny, nz, data) of the ``slabs`` view: one row for each frame of a file, as the operators on volumes at rest take them.

    A frame's slabs meet in one row, so it has to fit into one array; :mod:`slabwise` works on the slabs.
    """
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("z", "data"))), lambda s: s["data"]))
    return slabs.groupBy(F.col("path").alias("vol_id"), "t", "nx", "ny", "nz").agg(parts.alias("data"))


def read_volumes(spark: SparkSession, path: str | list[str], view: str = "slabs", mode: str = "standard", **options) -> DataFrame:
    """A view of one or more files, folders or patterns."""
    register(spark)
    return spark.read.format("nifti").option("view", view).option("mode", mode).options(**options).load(path)


def catalog(spark: SparkSession, path: str | list[str], mode: str = "standard") -> DataFrame:
    """A row for each file: its size and its header's fields, ``error`` where it has none.

    Kept as a table it is an index: filters on shape, type or orientation choose files, and :func:`read_listed` opens no others.
    """
    register(spark)
    sizes = [f for p in ([path] if isinstance(path, str) else path) for f in volumes_listed(p, *PATTERNS)]
    known = spark.createDataFrame(sizes, "path string, size long")
    return spark.read.format("nifti").option("view", "header").option("mode", mode).load(path).join(known, "path")


def read_listed(files: DataFrame, view: str = "slabs", mode: str = "standard", damaged: str = "fail", slab_bytes: int = SLAB_BYTES, **bounds: tuple[int, int]) -> DataFrame:
    """A view of the files that files(path, size) lists, such as a filtered :func:`catalog`; no folder is listed.

    Large plain files are read in parts by several tasks. ``bounds`` are those of z, t, x and y, from and before: ``z=(40, 41)``.
    """
    ship_package(files.sparkSession)
    scan = Scan(view, mode, damaged)
    for name, (low, high) in bounds.items():
        scan.within(name, low, high)
    parts = F.when(F.col("path").endswith(".nii.gz"), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / slab_bytes))).cast("int")
    pieces = files.select("path", parts.alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan.read(p for rows in batches for p in zip(*(rows.column(k).to_pylist() for k in range(3))))

    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # A file that is small shares a task with others.
    return dealt(pieces.select("path", "part", "parts"), max(-(-total[0] // slab_bytes), min(total[1], spark_cores(files)))).mapInArrow(read, scan.schema)


def spark_cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def dealt(pieces: DataFrame, tasks: int) -> DataFrame:
    """Rows that are small and stand for much work, dealt evenly to so many tasks; Spark would put them together by their own size."""
    return pieces.repartition(max(1, min(tasks, TASKS)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    ship_package(spark)
    spark.dataSource.register(NiftiDataSource)
