"""Decoded volumes kept as a Parquet table, so that slices are read again without opening, inflating or rescaling a file.

The table is a cache that outlives the session and needs no memory: slabs lie in the order of (path, t, z) in small row groups, whose
least and greatest values Parquet keeps, so a filter on a path or on z reads the row groups that may hold it and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, about; one holds some slabs of a volume.
ROW_GROUP_BYTES = 8 << 20


def keep(slabs: DataFrame, folder: str, mode: str = "error") -> DataFrame:
    """Write the ``slabs`` view to a table and return it as it is read from there; ``mode`` as for any table, ``append`` adds volumes.

    Volumes are spread over tasks by ranges of (path, t, z), a large one over several.
    """
    keys = ("path", "t", "z")
    slabs.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    return kept(slabs.sparkSession, folder)


def kept(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def missing(files: DataFrame, decoded: DataFrame) -> DataFrame:
    """Of files(path, ...), such as a catalog, those that the table has no slab of."""
    return files.join(decoded.select("path").distinct(), "path", "left_anti")


def without(decoded: DataFrame, *paths: str) -> DataFrame:
    """The table's slabs but for some volumes, to be written anew when these are dropped."""
    return decoded.where(~F.col("path").isin(*paths))
