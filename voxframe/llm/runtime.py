"""Session settings shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship_package

#: Bytes that one Arrow batch between the JVM and a Python worker may hold.
ARROW_BATCH_BYTES = 16 << 20
#: Spark's own bound, as the session gives it where nothing is set.
DEFAULT_BATCH = f"{64 << 20}b"


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package, and bound Arrow batches by bytes to less than Spark's default, as several are in memory at a time.

    The bound holds for the session from here on, as plans run later; one that the caller has set stays.
    """
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH:
        spark.conf.set(name, str(ARROW_BATCH_BYTES))
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage at a copy in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    """Null texts count as empty in every operator."""
    return F.coalesce(F.col(column), F.lit(""))
