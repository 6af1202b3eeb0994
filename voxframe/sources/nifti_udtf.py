"""``nifti_voxels(TABLE(files))``: the voxels of NIfTI files in bytes, as a table function for SQL.

    SELECT path, x, y, z, v FROM nifti_voxels(TABLE(SELECT path, content FROM files)) WHERE error IS NULL

``files`` has path (a string) and content, in this order, as ``binaryFile`` reads them. They go to the function as Arrow batches, each task its own.
Content that isn't a whole NIfTI file of numbers, null too, gives one row, with what is wrong in ``error`` and no voxel. (Spark
doesn't take functions on Arrow data behind LATERAL.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..session import ship_package
from .nifti import VIEWS, Rows, decoded_content
from .volume_files import Unreadable


class NiftiVoxels:
    """Yields batches of bounded size, however large a volume is."""

    def eval(self, files: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = Rows("voxels", True)
        for path, raw in zip(files.column(0).to_pylist(), files.column(1)):
            try:
                for h, t, z, cube in decoded_content(raw.as_py()):
                    if rows.add(path, h, t, z, cube):
                        yield pa.Table.from_batches([rows.batch()])
            except Unreadable as e:
                rows.damaged(path, str(e))
        if rows.pieces:
            yield pa.Table.from_batches([rows.batch()])


def register(spark: SparkSession, name: str = "nifti_voxels"):
    """Make the function known to the session's SQL; returns it, for the DataFrame API."""
    ship_package(spark)
    function = arrow_udtf(NiftiVoxels, returnType=f"{VIEWS['voxels']}, error string")
    spark.udtf.register(name, function)
    return function
