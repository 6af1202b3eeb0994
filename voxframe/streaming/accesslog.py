"""Streams of cache accesses: entries swept after idle time, bursts reduced to their last event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Idle seconds after which a sweep drops an entry, by kind of cache.
IDLE_SECONDS = {"data": 120, "file_slice": 60, "slice": 90}
#: Seconds between sweeps by the clock.
SWEEP_SECONDS = 30
#: Groups that the entries of a stream are dealt to.
BUCKETS = 1 << 14


def swept(accesses: DataFrame, lateness: str = "30 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Stream of (key, kind, accesses, last_ts, expired): entries as they are used, and once more when swept.

    ``accesses`` is a stream of (key, kind, ts). Of an entry its count and last use are kept; it leaves in
    event time when the watermark passes its last use by the kind's idle time; kinds that IDLE_SECONDS doesn't name have the longest of
    these. Null times are left out. There is a row for each entry and batch that uses it, so how many depends on the batches; ``idle.swept_by_clock``
    gives each entry once, by the clock.

    A call into Python costs milliseconds, so entries aren't groups of their own: ``buckets`` groups, by a hash, hold them, and a bucket's
    state is read and written when one of its entries is used or due. The number can't be changed once a stream has a checkpoint.
    """

    def update(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(name, kind): (count, last, due) for name, kind, count, last, due in zip(*state.get)} if state.exists else {}
        now, used = state.getCurrentWatermarkMs(), {}
        if not state.hasTimedOut:
            for rows in batches:
                times = (rows["ts"].to_numpy().astype("datetime64[us]").astype("int64") // 1000).tolist()  # whole milliseconds, exactly
                for name, kind, ms in zip(_texts(rows["key"]), _texts(rows["kind"]), times):
                    count, last = used.get((name, kind)) or held.get((name, kind), (0, 0))[:2]
                    used[name, kind] = count + 1, max(last, ms)
        for (name, kind), (count, last) in used.items():
            idle = IDLE_SECONDS.get(kind, max(IDLE_SECONDS.values())) * 1000
            held[name, kind] = count, last, max(last + idle, now + 1)
        gone = {entry: held.pop(entry)[:2] for entry in [e for e, (_, _, due) in held.items() if due < now]}
        if held:
            state.update(tuple(map(list, zip(*(entry + values for entry, values in held.items())))))
            state.setTimeoutTimestamp(min(due for _, _, due in held.values()))
        else:
            state.remove()
        found = [(*entry, *values, expired) for entries, expired in ((used, False), (gone, True)) for entry, values in entries.items()]
        if found:
            names, kinds, counts, lasts, expired = zip(*found)
            yield pd.DataFrame({"key": names, "kind": kinds, "accesses": counts, "last_ts": pd.to_datetime(lasts, unit="ms"), "expired": expired})

    named = accesses.where("ts IS NOT NULL").select(F.col("key").cast("string"), F.col("kind").cast("string"), "ts").withWatermark("ts", lateness)
    dealt = named.withColumn("bucket", F.pmod(F.xxhash64("key", "kind"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(
        update, "key string, kind string, accesses long, last_ts timestamp, expired boolean",
        "keys array<string>, kinds array<string>, accesses array<long>, lasts array<long>, dues array<long>", "append", GroupStateTimeout.EventTimeTimeout,
    )


def _texts(column: pd.Series) -> list:
    """The column's texts, None for a null, whatever pandas makes of it."""
    return column.astype(object).where(column.notna(), None).tolist()


def bursts(events: DataFrame, key: str, gap: str = "180 milliseconds", lateness: str = "1 second") -> DataFrame:
    """Stream of (key, start, last_ts, events): one row for each burst, closed once nothing followed for ``gap``."""
    windowed = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), key)
    return windowed.agg(F.max("ts").alias("last_ts"), F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), "last_ts", "events")


def arriving(spark, folder: str, per_batch: int = 64) -> DataFrame:
    """Stream of (path, content) of volume files as they arrive in a folder, ``per_batch`` files at a time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.nii*").option("maxFilesPerTrigger", per_batch).load(folder).select("path", "content")
