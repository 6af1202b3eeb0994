"""The binary form of a preview, and of single slices.

Little-endian: header length and JSON, range as two float32, the three slice indices as uint32, then for
axial, coronal and sagittal the length in bytes and the float32 voxels.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from ..session import ship_package

#: Zero bytes at the end, which writers of this form leave.
PADDING = 4

PREVIEW = "path string, header string, lo float, hi float, idx array<int>, axial array<float>, coronal array<float>, sagittal array<float>"


def encode(header: str, lo: float, hi: float, idx: list[int], slices: list[np.ndarray], padding: int = PADDING) -> bytes:
    text = header.encode()
    parts = [struct.pack("<I", len(text)), text, struct.pack("<2f3I", lo, hi, *idx)]
    for values in slices:
        raw = np.asarray(values, "<f4").tobytes()
        parts += [struct.pack("<I", len(raw)), raw]
    return b"".join([*parts, bytes(padding)])


def decode(raw: bytes) -> tuple[str, float, float, list[int], list[np.ndarray]]:
    (size,) = struct.unpack_from("<I", raw)
    header = raw[4 : 4 + size].decode()
    json.loads(header)
    lo, hi, *idx = struct.unpack_from("<2f3I", raw, 4 + size)
    at, slices = 4 + size + 20, []
    for _ in AXES:
        (n,) = struct.unpack_from("<I", raw, at)
        slices.append(np.frombuffer(raw, "<f4", n // 4, at + 4))
        at += 4 + n
    return header, lo, hi, list(idx), slices


def encode_previews(previews: DataFrame) -> DataFrame:
    """(path, payload) of previews of the PREVIEW columns."""
    ship_package(previews.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            payload = [encode(r.header, r.lo, r.hi, list(r.idx), [getattr(r, a) for a in AXES]) for r in rows.itertuples()]
            yield pd.DataFrame({"path": rows["path"], "payload": payload})

    return previews.mapInPandas(run, "path string, payload binary")


def decode_previews(payloads: DataFrame) -> DataFrame:
    """The PREVIEW columns of payloads(path, payload)."""
    ship_package(payloads.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, raw in zip(rows["path"], rows["payload"]):
                header, lo, hi, idx, slices = decode(bytes(raw))
                out.append((path, header, lo, hi, idx, *slices))
            yield pd.DataFrame(out, columns=["path", "header", "lo", "hi", "idx", *AXES])

    return payloads.mapInPandas(run, PREVIEW)


def preview_json(previews: DataFrame, partial: bool = False) -> DataFrame:
    """(path, json) of previews of the PREVIEW columns.

    ``partial`` previews have the axial slice alone, the other two filled with zeros, and say so.
    """
    empty = lambda a: F.transform(a, lambda v: F.lit(0.0).cast("float"))
    slices = [F.col("axial"), *(empty(a) if partial else F.col(a) for a in AXES[1:])]
    body = F.to_json(F.struct(*[c.alias(a) for a, c in zip(AXES, slices)], F.col("lo").alias("globalMin"), F.col("hi").alias("globalMax"), F.col("idx").alias("sliceIndices"), *([F.lit(True).alias("partialPreview")] if partial else [])))
    return previews.select("path", F.concat(F.lit('{"header":'), "header", F.lit(","), F.substr(body, F.lit(2))).alias("json"))


def write_json(texts: DataFrame, folder: str, compression: str = "gzip") -> None:
    """The json column as lines of text files, compressed."""
    texts.select("json").write.mode("overwrite").option("compression", compression).text(folder)
