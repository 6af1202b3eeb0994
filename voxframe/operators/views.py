"""What a viewer shows, put together from slices, colours and geometry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import intensity
from ..session import ship_package
from . import aggregate, voxels

THUMBNAIL = 64


def thumbnail(volumes: DataFrame, name: str = "gray", window: float = 1.0, level: float = 0.5, size: int = THUMBNAIL) -> DataFrame:
    """(vol_id, mx, my, r, g, b): the middle axial slice in colour, size x size pixels, top row first.

    The range is that of the three middle slices. Colour comes before scaling, so it is computed once a voxel.
    """
    low, high = aggregate.array_range(F.flatten(F.transform(voxels.middle_slices(), lambda s: s["part"])))
    ranged = volumes.withColumns({"lo": low, "hi": high})
    middle = voxels.slice_voxels(ranged, "axial", F.expr("nz div 2"), "nx", "ny", "lo", "hi")
    t = intensity.window_level(intensity.normalised(F.col("v"), F.col("lo"), F.col("hi")), window, level)
    coloured = intensity.apply_colormap(middle.withColumn("t", t), name)
    placed = coloured.withColumn("row", F.col("ny") - 1 - F.col("w"))
    wide = placed.select("vol_id", "r", "g", "b", "row", "ny", F.explode(voxels.target_pixels(F.col("u"), F.col("nx"), size)).alias("mx"))
    return wide.select("vol_id", "mx", F.explode(voxels.target_pixels(F.col("row"), F.col("ny"), size)).alias("my"), "r", "g", "b")


def lod_picture(volumes: DataFrame, level: int) -> DataFrame:
    """(vol_id, nx, ny, nz, data): the middle axial slice of each volume as block means by 2**level, a volume of one slice."""
    middle = voxels.slice_voxels(volumes, "axial", F.expr("nz div 2"), "nx", "ny")
    means = aggregate.lod(middle, F.col("nx"), F.col("ny"), level)
    pictures = means.groupBy("vol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("by", "bx", "v"))), lambda p: p["v"]).alias("data"), F.max("bx").alias("bx"), F.max("by").alias("by"))
    return pictures.select("vol_id", (F.col("bx") + 1).alias("nx"), (F.col("by") + 1).alias("ny"), F.lit(1).alias("nz"), "data")


def slice_bytes(slices: DataFrame) -> DataFrame:
    """(vol_id, axis, idx, payload): each slice as little-endian float32, row by row."""
    ship_package(slices.sparkSession)
    ordered = slices.groupBy("vol_id", "axis", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "u", "v"))), lambda p: p["v"]).alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["payload"] = [np.asarray(d, "<f4").tobytes() for d in rows.pop("data")]
            yield rows

    return ordered.mapInPandas(run, "vol_id long, axis string, idx int, payload binary")


def observed(slabs: DataFrame, name: str = "load") -> tuple[DataFrame, Observation]:
    """The slabs as they are, and what is counted while they are read by whatever follows: slabs, voxels, bytes of values, and least and greatest z.

    ``observation.get`` has the counts once an action has run; there is no pass for them alone.
    """
    seen = Observation(name)
    size = F.size("data").cast("long")
    counts = [F.count("*").alias("slabs"), F.coalesce(F.sum(size), F.lit(0)).alias("voxels"), F.coalesce(F.sum(size * 4), F.lit(0)).alias("bytes"), F.min("z").alias("first_z"), F.max("z").alias("last_z")]
    return slabs.observe(seen, *counts), seen


def metrics(log: DataFrame, key: str) -> DataFrame:
    """Counters and load times of log(key, kind, ms, resident), by key: loads, their mean time, failures, evictions, residents.

    Times are counted and summed and not listed, so a key's row stays small.
    """
    of = lambda k: F.col("kind") == k
    return log.groupBy(key).agg(
        *[F.count_if(of(k)).alias(f"{k}_loads") for k in ("preview", "full")],
        *[F.avg(F.when(of(k), F.col("ms"))).alias(f"{k}_ms") for k in ("preview", "full")],
        F.count_if(of("failure")).alias("failures"),
        F.count_if(of("eviction")).alias("evictions"),
        F.count_if(F.col("resident")).alias("residents"),
    )
