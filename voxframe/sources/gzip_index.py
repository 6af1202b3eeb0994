"""Places at which a gzipped file can be entered, so that several tasks read one volume.

Inflating can begin at a border between two blocks of the compressed stream, given the 32 KiB of content before it. One pass over a file
notes such a place about every ``span`` bytes of content, and sees all checksums on its way, so a file that has an index is whole. The
index is a table of the caller's, built once. A task then enters its file at its place and inflates its own stretch, and one slab is
found by inflating about one span.

zlib does the work, by its C interface: Python's own module has no way to stop at a border or to begin at a bit.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .nifti import Rows, Scan, dealt, end_of_voxels, frames, open_volume
from .volume_files import Unreadable, is_remote, located

SPAN = 8 << 20
#: Content that a stretch needs from before it, and compressed bytes that are read at a time.
WINDOW, INPUT_BYTES = 32 << 10, 1 << 16

# Fixed values of zlib's interface.
Z_OK, Z_STREAM_END, Z_BUF_ERROR, Z_NO_FLUSH, Z_BLOCK = 0, 1, -5, 0, 5
#: Window bits of a raw stream, and of one that begins with a gzip header.
RAW, GZIP = -15, 31


class _Stream(ctypes.Structure):
    _fields_ = [
        ("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong), ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong),
        ("msg", ctypes.c_char_p), ("state", ctypes.c_void_p), ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p), ("opaque", ctypes.c_void_p), ("data_type", ctypes.c_int),
        ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong),
    ]


@functools.cache
def _library() -> ctypes.CDLL:
    name = ctypes.util.find_library("z")
    if name is None:
        raise OSError("zlib's shared library isn't here; gzipped files can be read without an index")
    library = ctypes.CDLL(name)
    library.zlibVersion.restype = ctypes.c_char_p
    return library


class Inflater:
    """A stream of zlib over a file that is open at the place to begin."""

    def __init__(self, file, bits: int):
        self.file, self.z, self.stream = file, _library(), _Stream()
        self.check(self.z.inflateInit2_(ctypes.byref(self.stream), bits, self.z.zlibVersion(), ctypes.sizeof(_Stream)))
        self.given, self.consumed = b"", 0

    def check(self, code: int, *good: int) -> int:
        if code not in (Z_OK, *good):
            raise Unreadable(f"gzip: {(self.stream.msg or b'').decode() or f'zlib says {code}'}")
        return code

    def fill(self) -> bool:
        """Give the stream bytes to work on; false at the file's end."""
        if not self.stream.avail_in:
            self.given = self.file.read(INPUT_BYTES)
            self.stream.next_in, self.stream.avail_in = ctypes.cast(ctypes.c_char_p(self.given), ctypes.c_void_p), len(self.given)
            self.consumed += len(self.given)
        return bool(self.stream.avail_in)

    @property
    def place(self) -> int:
        """Bytes of the file, from where it was opened, that have been used."""
        return self.consumed - self.stream.avail_in

    def step(self, most: int, flush: int) -> tuple[bytes, bool]:
        """Up to ``most`` bytes of content, and whether the stream has ended."""
        out = ctypes.create_string_buffer(most)
        self.stream.next_out, self.stream.avail_out = ctypes.cast(out, ctypes.c_void_p), most
        code = self.check(self.z.inflate(ctypes.byref(self.stream), flush), Z_STREAM_END, Z_BUF_ERROR)
        return out.raw[: most - self.stream.avail_out], code == Z_STREAM_END

    def again(self, bits: int) -> None:
        """Begin a new stream at this place of the file."""
        self.check(self.z.inflateReset2(ctypes.byref(self.stream), bits))

    def another(self) -> bool:
        """Pass over zeros, which may fill up a file, and begin the member that follows; false if there is none."""
        while self.fill():
            left = self.given[len(self.given) - self.stream.avail_in :]
            self.skip(len(left) - len(left.lstrip(b"\0")))
            if self.stream.avail_in:
                self.again(GZIP)
                return True
        return False

    def skip(self, n: int) -> None:
        while n and self.fill():
            some = min(n, self.stream.avail_in)
            self.stream.next_in, self.stream.avail_in = self.stream.next_in + some, self.stream.avail_in - some
            n -= some

    def close(self) -> None:
        self.z.inflateEnd(ctypes.byref(self.stream))


class Point(NamedTuple):
    """A place to enter: offset in the content, in the file, bits of the byte before that belong to what follows, and the compressed window
    (none where a member of the file begins)."""

    out: int
    inp: int
    bits: int
    window: bytes


def _file(path: str):
    if is_remote(path):
        raise Unreadable("files behind http have no index")
    system, inside, _ = located(path)
    return system.open_input_file(inside)


def build(path: str, span: int = SPAN) -> tuple[list[Point], int]:
    """The places to enter a gzipped file, at least one, and the size of its content; Unreadable if a part of it is damaged."""
    with _file(path) as file:
        points, out, window = [Point(0, 0, 0, b"")], 0, b""
        stream = Inflater(file, GZIP)
        try:
            ended = True
            while stream.fill():
                if ended and out:
                    if not stream.another():
                        break
                    window = b""
                    if out - points[-1].out >= span:
                        points.append(Point(out, stream.place, 0, b""))
                part, ended = stream.step(WINDOW, Z_BLOCK)
                out += len(part)
                window = (window + part)[-WINDOW:]
                kind = stream.stream.data_type
                # At the border of two blocks, of which the one before isn't the last.
                if kind & 128 and not kind & 64 and not ended and out - points[-1].out >= span:
                    points.append(Point(out, stream.place, kind & 7, zlib.compress(window, 1)))
            if not ended or not out:
                raise Unreadable("gzip: it ends before the stream does")
        finally:
            stream.close()
    return points, out


class Entered:
    """Byte ranges of a gzipped file's content from a place on; ranges follow each other."""

    def __init__(self, path: str, point: Point):
        self.file = _file(path)
        self.at, self.rest = point.out, b""
        # The byte in which the stretch begins has bits of it.
        self.file.seek(point.inp - (1 if point.bits else 0))
        first = self.file.read(1)[0] if point.bits else 0
        self.raw = bool(point.window)
        self.stream = Inflater(self.file, RAW if self.raw else GZIP)
        if point.bits:
            self.stream.check(self.stream.z.inflatePrime(ctypes.byref(self.stream.stream), point.bits, first >> (8 - point.bits)))
        if self.raw:
            window = zlib.decompress(point.window)
            self.stream.check(self.stream.z.inflateSetDictionary(ctypes.byref(self.stream.stream), window, len(window)))

    def read(self, start: int, size: int) -> bytes:
        """The bytes from ``start``, not before what was read last, on."""
        out, have = [], 0
        while have < size:
            if not self.rest and not self._more():
                break
            skip = min(len(self.rest), max(0, start - self.at))
            self.rest, self.at = self.rest[skip:], self.at + skip
            if self.at >= start:
                part, self.rest = self.rest[: size - have], self.rest[size - have :]
                self.at += len(part)
                have += len(part)
                out.append(part)
        return b"".join(out)

    def _more(self) -> bool:
        while self.stream.fill():
            self.rest, ended = self.stream.step(INPUT_BYTES * 4, Z_NO_FLUSH)
            if ended:
                if self.raw:  # the member's checksum and size
                    self.stream.skip(8)
                self.stream.another()
                self.raw = False
            if self.rest:
                return True
        return False

    def close(self) -> None:
        self.stream.close()
        self.file.close()


_INDEX = "path string, content_bytes long, vox_offset long, slab_bytes long, nz int, frames int, points array<struct<out:long,inp:long,bits:int,window:binary>>, error string"


def gzip_index(files: DataFrame, mode: str = "standard", span: int = SPAN) -> DataFrame:
    """The index of gzipped volumes files(path), a row for each: where to enter it, and what tells its slabs' places.

    Each file is inflated once, by one task, and its checksums are verified. A file that is damaged or no volume has an error, and no places. Keep
    it as a table; :func:`read_indexed` reads volumes by it.
    """
    ship_package(files.sparkSession)
    kind = pa.list_(pa.struct([("out", pa.int64()), ("inp", pa.int64()), ("bits", pa.int32()), ("window", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path in rows.column(0).to_pylist():
                try:
                    source, h = open_volume(path, mode)
                    source.close()
                    if h["paired"]:
                        raise Unreadable("its voxels are in another file")
                    points, size = build(path, span)
                    if size < end_of_voxels(h):
                        raise Unreadable(f"its content has {size} bytes of {end_of_voxels(h)}")
                    row = [path, size, h["vox_offset"], h["slice_size"] * h["bytes_per_voxel"], h["nz"], frames(h), [p._asdict() for p in points], None]
                except Unreadable as e:
                    row = [path, *[None] * 6, str(e)]
                types = [pa.string(), *[pa.int64()] * 3, *[pa.int32()] * 2, kind, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [f.split()[0] for f in _INDEX.replace("array<struct<out:long,inp:long,bits:int,window:binary>>", "x").split(", ")])

    return dealt(files.select("path"), files.count()).mapInArrow(run, _INDEX)


def read_indexed(index: DataFrame, view: str = "slabs", mode: str = "standard", **bounds: tuple[int, int]) -> DataFrame:
    """A view of the files of a :func:`gzip_index`, each read by as many tasks as it has places to enter.

    A task reads the slabs that begin in its stretch. ``bounds`` are those of z, t, x and y, from and before: places from which no wanted slab
    is read aren't entered. Files with an error are left out.
    """
    ship_package(index.sparkSession)
    scan = Scan(view, mode)
    for name, (low, high) in bounds.items():
        scan.within(name, low, high)
    (z0, z1), (t0, t1) = scan.bounds["z"], scan.bounds["t"]
    places = index.where("error IS NULL").select("path", "content_bytes", "vox_offset", "slab_bytes", "nz", "frames", F.posexplode("points").alias("k", "point"), F.transform("points", lambda p: p["out"]).alias("outs"))
    end = F.coalesce(F.get("outs", F.col("k") + 1), F.col("content_bytes"))
    slab = lambda at: F.greatest(F.lit(0), F.ceil((at - F.col("vox_offset")) / F.col("slab_bytes"))).cast("long")
    places = places.select("path", "nz", "frames", "point", slab(F.col("point.out")).alias("first"), F.least(slab(end), F.col("nz") * F.col("frames").cast("long")).alias("last")).where("first < last")
    wanted = F.exists(F.sequence("first", F.col("last") - 1), lambda s: (s % F.col("nz")).between(z0, z1 - 1) & (F.floor(s / F.col("nz"))).between(t0, t1 - 1))
    places = places.where(wanted).select("path", "point.out", "point.inp", "point.bits", "point.window", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(view)
        for part in batches:
            for path, out, inp, bits, window, first, last in zip(*(part.column(k).to_pylist() for k in range(7))):
                source, h = open_volume(path, mode)
                source.close()
                entered = Entered(path, Point(out, inp, bits, window or b""))
                try:
                    nz = h["nz"]
                    t, z = np.divmod(np.arange(first, last), nz)
                    keep = (z >= z0) & (z < z1) & (t >= t0) & (t < t1)
                    for piece in scan.cubes(entered, h, [(int(a), int(b), int(b) + 1) for a, b in zip(t[keep], z[keep])]):
                        if rows.add(path, h, *piece):
                            yield rows.batch()
                finally:
                    entered.close()
        if rows.pieces:
            yield rows.batch()

    return dealt(places, places.count()).mapInArrow(run, scan.schema)

