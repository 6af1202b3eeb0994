"""From stored values to colours, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numeric import clamp

# Colour stops (position, red, green, blue) of the two table-based maps.
STOPS = {
    "viridis": [(0, 68, 1, 84), (0.13, 72, 36, 117), (0.25, 65, 68, 135), (0.38, 53, 95, 141), (0.5, 42, 120, 142), (0.63, 33, 145, 140), (0.75, 34, 168, 132), (0.88, 68, 191, 112), (1, 253, 231, 37)],
    "inferno": [(0, 0, 0, 4), (0.13, 40, 11, 84), (0.25, 101, 21, 110), (0.38, 159, 42, 99), (0.5, 212, 72, 66), (0.63, 245, 125, 21), (0.75, 250, 193, 39), (0.88, 234, 247, 132), (1, 252, 255, 164)],
}

LUT_SIZE = 256


def rescale(value: Column, slope: Column, inter: Column) -> Column:
    """value*slope + inter in double, stored as float."""
    return (value.cast("double") * slope + inter).cast("float")


def normalised(value: Column, low: Column, high: Column) -> Column:
    """Place of the value between ``low`` and ``high``; a range of zero counts as one."""
    span = high.cast("double") - low.cast("double")
    return (value.cast("double") - low.cast("double")) / F.when(span == 0, 1.0).otherwise(span)


def window_level(norm: Column, window, level) -> Column:
    """Display value 0..1 of a normalised value under a window around ``level``; a window of zero counts as one."""
    window, level = (c if isinstance(c, Column) else F.lit(float(c)) for c in (window, level))
    width = F.when(window == 0, 1.0).otherwise(window)
    return clamp((norm - (level - window / 2.0)) / width, 0.0, 1.0)


def _unit(value: Column) -> Column:
    return clamp(value, 0.0, 1.0)


#: Red, green and blue (0..255, unrounded) of t (0..1) for the maps that are formulas.
FORMULAS = {
    "gray": lambda t: (t * 255.0, t * 255.0, t * 255.0),
    "hot": lambda t: tuple(_unit(t * 3.0 - k) * 255.0 for k in (0.0, 1.0, 2.0)),
    "cool": lambda t: ((1.0 - t) * 255.0, t * 255.0, F.lit(255.0)),
    "jet": lambda t: tuple(_unit(1.5 - F.abs(t * 4.0 - k)) * 255.0 for k in (3.0, 2.0, 1.0)),
}

MAPS = (*FORMULAS, *STOPS)


def pixel(channel: Column) -> Column:
    """A channel as an 8-bit pixel stores it."""
    return F.floor(clamp(channel, 0.0, 255.0) + 0.5).cast("int")


def lut_index(t: Column) -> Column:
    return clamp(F.floor(t * float(LUT_SIZE - 1)), 0, LUT_SIZE - 1).cast("int")


def colour_table(spark: SparkSession, name: str) -> DataFrame:
    """(k, r, g, b): LUT_SIZE entries between the stops of a map, a range join of entries and segments."""
    stops = STOPS[name]
    segments = [(n, *map(float, a), *map(float, b)) for n, (a, b) in enumerate(zip(stops, stops[1:]))]
    ends = spark.createDataFrame(segments, "n int, t0 double, r0 double, g0 double, b0 double, t1 double, r1 double, g1 double, b1 double")
    entries = spark.range(LUT_SIZE).select(F.col("id").cast("int").alias("k"), (F.col("id") / float(LUT_SIZE - 1)).alias("t"))
    hits = entries.join(F.broadcast(ends), (F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1")))
    first = hits.groupBy("k", "t").agg(F.min_by(F.struct("t0", "r0", "g0", "b0", "t1", "r1", "g1", "b1"), "n").alias("s"))
    part = (F.col("t") - F.col("s.t0")) / (F.col("s.t1") - F.col("s.t0"))
    return first.select("k", *(F.floor(F.col(f"s.{c}0") + (F.col(f"s.{c}1") - F.col(f"s.{c}0")) * part + 0.5).cast("int").alias(c) for c in "rgb"))


def apply_colormap(df: DataFrame, name: str, t: str = "t") -> DataFrame:
    """Adds 8-bit r, g, b for column ``t``: by formula, or by a join with the map's table of 256 rows."""
    if name in FORMULAS:
        return df.withColumns(dict(zip("rgb", map(pixel, FORMULAS[name](F.col(t))))))
    if name not in STOPS:
        raise ValueError(f"no colormap named {name!r}; there are {', '.join(MAPS)}")
    table = colour_table(df.sparkSession, name).withColumnRenamed("k", "_k")
    return df.withColumn("_k", lut_index(F.col(t))).join(F.broadcast(table), "_k").drop("_k")


def blend(first: Column, second: Column, opacity) -> Column:
    """A channel of two pictures, the second drawn over the first with ``opacity``."""
    return first * (1.0 - opacity) + second * opacity
