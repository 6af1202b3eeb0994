"""Small tables beside large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder


def kept(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder, so that they are computed once."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_within(df: DataFrame, limit: int) -> DataFrame:
    """The rows, to be broadcast if there are no more than ``limit`` of them; a join with more shuffles. They should be :func:`kept`."""
    return F.broadcast(df) if df.count() <= limit else df
