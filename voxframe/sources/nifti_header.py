"""Headers of NIfTI-1 and NIfTI-2 files.

One parser for all readers. In NIfTI-2 files ``mode='standard'`` reads geometry where the public layout has
it; ``mode='reference'`` reads it at the places some viewers use, which differ.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ORIENTATIONS
from .volume_files import Unreadable

MODES = ("standard", "reference")

# Bytes of an element by type code.
TYPE_BYTES = {1: 1, 2: 1, 4: 2, 8: 4, 16: 4, 64: 8, 128: 3, 256: 1, 512: 2, 768: 4, 1024: 8, 1280: 8, 4096: 4}

HEADER_BYTES = {1: 348, 2: 540}
FIRST_DATA_BYTE = {1: 352, 2: 544}
#: Bytes that hold either header.
PREFIX_BYTES = 544

# Fields of the public layouts: name, offset, struct format.
LAYOUT_1 = [
    ("dim", 40, "8h"), ("datatype", 70, "h"), ("bitpix", 72, "h"), ("pixdim", 76, "8f"), ("vox_offset", 108, "f"), ("scl_slope", 112, "f"), ("scl_inter", 116, "f"),
    ("xyzt_units", 123, "B"), ("descrip", 148, "80s"), ("qform_code", 252, "h"), ("sform_code", 254, "h"), ("quatern", 256, "3f"), ("qoffset", 268, "3f"),
    ("srow_x", 280, "4f"), ("srow_y", 296, "4f"), ("srow_z", 312, "4f"), ("magic", 344, "4s"),
]
LAYOUT_2 = [
    ("magic", 4, "8s"), ("datatype", 12, "h"), ("bitpix", 14, "h"), ("dim", 16, "8q"), ("pixdim", 104, "8d"), ("vox_offset", 168, "q"), ("scl_slope", 176, "d"), ("scl_inter", 184, "d"),
    ("descrip", 240, "80s"), ("qform_code", 344, "i"), ("sform_code", 348, "i"), ("quatern", 352, "3d"), ("qoffset", 376, "3d"),
    ("srow_x", 400, "4d"), ("srow_y", 432, "4d"), ("srow_z", 464, "4d"), ("xyzt_units", 500, "i"),
]
# Where 'reference' reads NIfTI-2 geometry instead; spacing there starts with the first of pixdim.
LAYOUT_2_REFERENCE = LAYOUT_2[:4] + [
    ("pixdim", 96, "8d"), ("vox_offset", 168, "q"), ("scl_slope", 176, "d"), ("scl_inter", 184, "d"), ("qform_code", 196, "h"), ("sform_code", 198, "h"),
    ("quatern", 200, "3f"), ("qoffset", 212, "3f"), ("srow_x", 224, "4d"), ("srow_y", 256, "4d"), ("srow_z", 288, "4d"), ("xyzt_units", 496, "i"),
]

SCHEMA = (
    "version int, ndim int, nx long, ny long, nz long, nt long, nu long, dx double, dy double, dz double, dt double, qfac double, "
    "datatype int, bitpix int, vox_offset long, scl_slope double, scl_inter double, little_endian boolean, is_gzip boolean, "
    "bytes_per_voxel long, total_voxels long, slice_size long, volume_bytes long, qform_code int, sform_code int, "
    "quatern_b double, quatern_c double, quatern_d double, qoffset_x double, qoffset_y double, qoffset_z double, "
    "srow_x array<double>, srow_y array<double>, srow_z array<double>, descrip string, xyzt_units int, orientation string, paired boolean"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


class NotNifti(Unreadable):
    """The bytes don't start with a NIfTI header."""


# What the magic string begins with, of single files and of pairs of files, by version.
SINGLE, PAIR = {1: b"n+1\0", 2: b"n+2\0"}, {1: b"ni1\0", 2: b"ni2\0"}


def _or(value: float, default: float) -> float:
    return default if not value or math.isnan(value) else value


def orientation_code(rows: list[tuple[float, ...]]) -> str:
    """Orientation of affine rows; ties go to the lower axis."""
    code = ""
    for row in rows:
        axis = max(range(3), key=lambda k: (abs(row[k]), -k))
        code += ("RL", "AP", "SI")[axis][row[axis] < 0]
    return code if code in ORIENTATIONS else "unknown"


def parse_header(raw: bytes, is_gzip: bool = False, mode: str = "standard") -> dict:
    """Fields of SCHEMA from the first bytes of a file (inflated); raises NotNifti.

    In mode 'standard' the magic string has to be that of the version; 'reference' doesn't look at it but to find that voxels are in another file.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if len(raw) < HEADER_BYTES[1]:
        raise NotNifti(f"{len(raw)} bytes are too few for a header")
    sizes = {order: struct.unpack_from(f"{order}i", raw)[0] for order in "<>"}
    found = [(v, o) for v in (1, 2) for o in "<>" if sizes[o] == HEADER_BYTES[v]]
    if not found:
        raise NotNifti(f"header size {sizes['<']} is neither 348 nor 540")
    version, order = found[0]
    if len(raw) < HEADER_BYTES[version]:
        raise NotNifti(f"{len(raw)} bytes are too few for a header")
    layout = LAYOUT_1 if version == 1 else LAYOUT_2 if mode == "standard" else LAYOUT_2_REFERENCE
    h = {}
    for name, at, form in layout:
        value = struct.unpack_from(order + form, raw, at)
        h[name] = value[0] if len(value) == 1 else value
    magic = h["magic"][:4]
    if mode == "standard" and magic not in (SINGLE[version], PAIR[version]):
        raise NotNifti(f"the magic string is {magic!r}")
    paired = magic == PAIR[version]
    dim, spacing = h["dim"], h["pixdim"]
    ndim = dim[0]
    n = [max(1, dim[1]), max(1, dim[2]), max(1, dim[3]), max(1, dim[4]) if ndim >= 4 else 1, max(1, dim[5]) if ndim >= 5 else 1]
    size = TYPE_BYTES.get(h["datatype"], max(1, h["bitpix"] // 8))
    offset = h["vox_offset"]
    code = "RAS"
    if h["sform_code"]:
        code = orientation_code([h["srow_x"], h["srow_y"], h["srow_z"]])
    text = h.get("descrip", b"").split(b"\0")[0].decode("utf-8", "replace")
    return dict(
        zip(
            FIELDS,
            [
                version, ndim, *n, *(_or(abs(d), 1.0) for d in spacing[1:4]), _or(spacing[4], 0.0), -1.0 if spacing[0] == -1 else 1.0,
                h["datatype"], h["bitpix"], max(0 if paired else FIRST_DATA_BYTE[version], int(offset) if offset == offset else 0),
                float(_or(h["scl_slope"], 1.0)), float(_or(h["scl_inter"], 0.0)), order == "<", is_gzip,
                size, n[0] * n[1] * n[2], n[0] * n[1], n[0] * n[1] * n[2] * size, h["qform_code"], h["sform_code"],
                *map(float, h["quatern"]), *map(float, h["qoffset"]), *(list(map(float, h[f"srow_{a}"])) for a in "xyz"), text, h["xyzt_units"], code, paired,
            ],
        )
    )


def slice_byte_range(header: dict, axis: str, index: int, frame: int = 0) -> tuple[int, int] | None:
    """First and last byte of a slice where it is contiguous in the file: axial ones only."""
    if axis != "axial":
        return None
    size = header["slice_size"] * header["bytes_per_voxel"]
    start = frame_byte_range(header, frame)[0] + index * size
    return start, start + size - 1


def frame_byte_range(header: dict, frame: int = 0) -> tuple[int, int]:
    """First and last byte of one frame of a 4-D file."""
    start = header["vox_offset"] + frame * header["volume_bytes"]
    return start, start + header["volume_bytes"] - 1


def parse_headers(files: DataFrame, mode: str = "standard") -> DataFrame:
    """path, the header's fields, and error, of files(path, content) whose content starts with a header.

    Only the first bytes of each content go to Python. A file that isn't NIfTI has an error and null fields.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, head in zip(rows["path"], rows["head"]):
                try:
                    out.append({"path": path, **parse_header(bytes(head), False, mode), "error": None})
                except NotNifti as e:
                    out.append({"path": path, **dict.fromkeys(FIELDS), "error": str(e)})
            yield pd.DataFrame(out, columns=["path", *FIELDS, "error"])

    head = F.substring("content", 1, PREFIX_BYTES)
    return files.select("path", F.coalesce(head, F.lit(b"")).alias("head")).mapInPandas(parsed, f"path string, {SCHEMA}, error string")


def header_json(headers: DataFrame) -> DataFrame:
    """(path, json): the header's fields as a JSON object, or {"error": ...}."""
    fields = [c for c in headers.columns if c not in ("path", "error")]
    plain = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return headers.select("path", F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(plain).alias("json"))


def parsed_json(texts: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """path, the fields of ``schema``, and error, of (path, json) as :func:`header_json` makes it; text that is no JSON object has an error too."""
    found = F.from_json("json", f"{schema}, error string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = texts.select("path", found.alias("h"))
    fields = [f.split()[0] for f in re.split(r", (?![^<]*>)", schema)]
    error = F.coalesce("h.error", F.when(F.col("h").isNull() | F.col("h._corrupt").isNotNull(), "not a header"))
    return rows.select("path", *[F.col(f"h.{f}") for f in fields], error.alias("error"))


def write_header(shape: tuple[int, ...], datatype: int, version: int = 1, order: str = "<", **fields) -> bytes:
    """The header bytes of a file in the standard layout, up to its first data byte; for sinks and tests."""
    layout = LAYOUT_1 if version == 1 else LAYOUT_2
    raw = bytearray(FIRST_DATA_BYTE[version])
    struct.pack_into(f"{order}i", raw, 0, HEADER_BYTES[version])
    dim = [len(shape), *shape, *[1] * (7 - len(shape))]
    values = {
        "dim": dim, "datatype": datatype, "bitpix": 8 * TYPE_BYTES.get(datatype, 1), "pixdim": [1.0] * 8, "vox_offset": FIRST_DATA_BYTE[version],
        "scl_slope": 1.0, "scl_inter": 0.0, "magic": b"n+1\0" if version == 1 else b"n+2\0\r\n\x1a\n",
    } | fields
    for name, at, form in layout:
        if name in values:
            v = values[name]
            struct.pack_into(order + form, raw, at, *(v if isinstance(v, (list, tuple)) else [v]))
    return bytes(raw)

