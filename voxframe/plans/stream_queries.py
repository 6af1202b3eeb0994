"""Queries over streams: ``events`` read as a stream, run until nothing is left, and what the sink then holds.

All of the table is one batch, so the watermark is the latest time less the lateness; what it has passed is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, ship_package
from ..streaming import accesslog

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = f"{sf_dir}/events.parquet"
    # A stream's source is a folder or a pattern; this one matches the table's own name alone.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame) -> DataFrame:
    """The rows that the stream writes until its source has no more, read from a table in the shared folder."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "q62_bursts",
    """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    b AS (SELECT user_id, ts, count(*) FILTER (gap IS NULL OR gap >= INTERVAL 2 HOURS) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS events FROM b GROUP BY user_id, n
    HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 SECOND""",
)
def bursts(spark, sf_dir):
    """Bursts of each user, closed once nothing followed for two hours; those that the watermark hasn't passed yet aren't given, here nor in SQL."""
    found = finished(accesslog.bursts(_stream(spark, sf_dir), "user_id", "2 hours"))
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last_ts").alias("last_us"), "events")


@query(
    "q63_sweep",
    """WITH k AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE event_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'file_slice' ELSE 'slice' END AS kind, ts FROM events),
    s AS (SELECT key, kind, count(*) AS accesses, CAST(epoch_us(max(ts)) // 1000 AS BIGINT) AS last_ms FROM k GROUP BY ALL)
    SELECT key, kind, accesses, last_ms, false AS expired FROM s UNION ALL
    SELECT key, kind, accesses, last_ms, true FROM s WHERE last_ms + CASE kind WHEN 'data' THEN 120 WHEN 'file_slice' THEN 60 ELSE 90 END * 1000 < (SELECT epoch_us(max(ts)) // 1000 FROM events) - 30000""",
)
def sweep(spark, sf_dir):
    """Cache entries as they are used, and once more when they are swept after their kind's idle time."""
    kind = F.when(F.col("event_id") % 3 == 0, "data").when(F.col("event_id") % 3 == 1, "file_slice").otherwise("slice")
    used = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), kind.alias("kind"), "ts")
    found = finished(accesslog.swept(used))
    return found.select("key", "kind", "accesses", F.unix_millis("last_ts").alias("last_ms"), "expired")
