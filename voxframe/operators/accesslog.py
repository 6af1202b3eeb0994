"""Caches, queues and interaction as window functions over a log of events.

Events follow each other by ``ts``. Of equal times they go by ``seq``, a column that numbers them, or, where none is named, by a hash of
the whole row: then the result is the same however rows were dealt, and only rows that are alike in all columns may change places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package

#: Samples of a bandwidth estimate, and its levels in Mb/s.
BANDWIDTH_SAMPLES, HIGH_MBPS, MEDIUM_MBPS = 10, 50, 10
CACHE_BYTES = 2 << 30
IDLE_SECONDS = 300
RESIDENT = 2
DEBOUNCE_MS = 180
#: Active loads of each class of a queue.
QUEUE_CAPS = {"remote": 1, "local": 2}
# HTTP statuses that are worth another try, besides 500 and above.
RETRYABLE = (408, 425, 429)
ZOOM_LIMITS = (0.5, 10.0)
#: Events of a key that are folded at a time.
FOLD_ROWS = 10_000


def _micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, of timestamps with and without a time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _order(log: DataFrame, seq: str | None) -> list[Column]:
    """What orders the events of a key: time, then their number or a hash of the row."""
    columns = [F.col(f"`{f.name}`") for f in log.schema if not re.search("map<|variant", f.dataType.simpleString())]
    return [F.col("ts"), F.col(seq) if seq else F.xxhash64(*columns)]


def bandwidth(samples: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Adds bps and level: bits a second over the last samples(ts, bytes, ms) of each ``key``, such as a client; those without a duration are left out."""
    base = Window.partitionBy(key).orderBy(*_order(samples, seq)).rowsBetween(1 - BANDWIDTH_SAMPLES, 0)
    sums = samples.where("ms > 0").withColumns({"_b": F.sum("bytes").over(base), "_m": F.sum("ms").over(base)})
    bps = F.col("_b") * 8000.0 / F.col("_m")
    mbps = bps / float(1 << 20)
    level = F.when(mbps > HIGH_MBPS, "high").when(mbps > MEDIUM_MBPS, "medium").otherwise("low")
    return sums.withColumns({"bps": bps, "level": level}).drop("_b", "_m")


def last_access(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(F.max("ts").alias("last_ts"))


def lru_within_budget(entries: DataFrame, key: str, group: str, budget: int = CACHE_BYTES) -> DataFrame:
    """Adds kept: entries(key, bytes, last_ts, pinned) that the cache of their ``group``, of ``budget`` bytes, still holds.

    Pinned entries come first and always stay, the others newest first while the bytes so far fit. A group,
    such as a host, is sorted by one task.
    """
    line = Window.partitionBy(group).orderBy(F.desc("pinned"), F.desc("last_ts"), F.asc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("kept", F.col("pinned") | (F.sum("bytes").over(line) <= budget))


def idle(entries: DataFrame, now: Column, seconds: int = IDLE_SECONDS) -> DataFrame:
    """Adds expired: unused for ``seconds`` or longer."""
    age = _micros(now) - _micros("last_ts")
    return entries.withColumn("expired", age >= seconds * 1_000_000)


def newest(entries: DataFrame, key: str, group: str, count: int) -> DataFrame:
    """Adds kept: pinned entries and the newest others of each ``group``, ``count`` in all; also the size cap of slice caches."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("pinned"), F.desc("last_ts"), F.asc(key)))
    return entries.withColumn("kept", F.col("pinned") | (rank <= count))


def admitted(jobs: DataFrame, group: str, caps: dict[str, int] | None = None) -> DataFrame:
    """Adds rank and active to jobs(class, priority, seq): by class, highest priority first, first come first, up to its cap.

    Each value of ``group``, such as a host or a user, has a queue of its own.
    """
    caps = QUEUE_CAPS if caps is None else caps
    rank = F.row_number().over(Window.partitionBy(group, "class").orderBy(F.desc("priority"), F.asc("seq")))
    cap = F.lit(0)
    for name, n in caps.items():
        cap = F.when(F.col("class") == name, n).otherwise(cap)
    return jobs.withColumn("rank", rank).withColumn("active", F.col("rank") <= cap)


def debounced(log: DataFrame, key: str, gap_ms: int = DEBOUNCE_MS, seq: str | None = None) -> DataFrame:
    """The last event of each burst: those that no other event of the key follows within the gap."""
    gap = _micros(F.lead("ts").over(Window.partitionBy(key).orderBy(*_order(log, seq)))) - _micros("ts")
    return log.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > gap_ms * 1000)).drop("_gap")


def panned(log: DataFrame, key: str, *moves: str, seq: str | None = None) -> DataFrame:
    """Adds the running sum of each move of a key, as sum_<name>."""
    line = Window.partitionBy(key).orderBy(*_order(log, seq)).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({f"sum_{m}": F.sum(m).over(line) for m in moves})


def zoomed(log: DataFrame, key: str, factor: str, seq: str | None = None) -> DataFrame:
    """(key, zoom): positive factors multiplied in the order of time, clamped after each step, from 1.

    A step maps a zoom to its clamped multiple, and a row of steps is such a map again: a factor and two bounds.
    So FOLD_ROWS events of a key are folded into one map, and then the maps, whatever the number of events.
    """
    low, high = map(F.lit, ZOOM_LIMITS)
    clamped = lambda x: F.greatest(low, F.least(high, x))
    identity = F.struct(F.lit(1.0).alias("f"), low.alias("lo"), high.alias("hi"))

    def then(m: Column, f: Column, lo: Column, hi: Column) -> Column:
        """The map m and after it the one of factor f and bounds lo and hi."""
        bounded = lambda x: F.greatest(lo, F.least(hi, x * f))
        return F.struct((m["f"] * f).alias("f"), bounded(m["lo"]).alias("lo"), bounded(m["hi"]).alias("hi"))

    # An event's number among its key's is the order in its part, too.
    number = F.row_number().over(Window.partitionBy(key).orderBy(*_order(log, seq))) - 1
    events = log.select(key, F.col(factor).cast("double").alias("_f"), number.alias("_n")).withColumn("_part", F.expr(f"_n div {FOLD_ROWS}"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_f"))), lambda e: e["_f"])
    maps = events.groupBy(key, "_part").agg(F.aggregate(steps, identity, lambda m, f: then(m, f, low, high)).alias("m"))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("_part", "m"))), identity, lambda m, p: then(m, p["m"]["f"], p["m"]["lo"], p["m"]["hi"]))
    return maps.groupBy(key).agg(whole.alias("m")).select(key, F.when(F.col("m.f").isNotNull(), clamped(F.greatest("m.lo", F.least("m.hi", "m.f")))).alias("zoom"))


def scrolled(log: DataFrame, key: str, delta: str, threshold: float = 30.0, seq: str | None = None, fast_at: float | None = 2.0) -> DataFrame:
    """(key, moved): slices moved by wheel events(ts, delta), in a fold.

    A step counts 2 while the wheel turns faster than ``fast_at`` units a millisecond, where deltas weigh half; without
    ``fast_at`` all steps count 1. The sum of deltas starts again from zero whenever it reaches the threshold. Null deltas are zero. Each
    task runs through its keys' events in order with two numbers in memory, however many events a key has.
    """
    ship_package(log.sparkSession)
    turned = F.coalesce(F.col(delta), F.lit(0))
    log = log.withColumn("_tie", _order(log, seq)[1])
    events, fast = log.repartition(key), F.lit(False)
    if fast_at is not None:
        events = events.withColumn("_ms", (_micros("ts") - _micros(F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "_tie")))) / 1000.0)
        fast = F.when(F.col("_ms") > 0, F.abs(turned) > fast_at * F.col("_ms")).otherwise(False)
    steps = events.select(key, "ts", "_tie", F.when(fast, turned * 0.5).otherwise(turned.cast("double")).alias("_d"), F.when(fast, 2).otherwise(1).alias("_step"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, moves, total = [], [], 0.0
        for rows in batches:
            for name, d, step in zip(*(rows.column(k).to_pylist() for k in range(3))):
                if not names or name != names[-1]:
                    names.append(name)
                    moves.append(0)
                    total = 0.0
                total += d
                if abs(total) >= threshold:
                    moves[-1] += step if total > 0 else -step
                    total = 0.0
            if len(names) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(names[:-1], rows.schema.field(0).type), pa.array(moves[:-1], pa.int32())], [key, "moved"])
                names, moves = names[-1:], moves[-1:]
            kind = rows.schema.field(0).type
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(moves, pa.int32())], [key, "moved"])

    kind = log.schema[key].dataType.simpleString()
    return steps.sortWithinPartitions(key, "ts", "_tie").select(key, "_d", "_step").mapInArrow(run, f"`{key}` {kind}, moved int")


def velocity(log: DataFrame, key: str, delta: str, seq: str | None = None) -> DataFrame:
    """Adds ms (since the key's last event) and velocity (units a millisecond, 0 without one) to the log."""
    now = F.floor(_micros("ts") / 1000)
    ms = now - F.lag(now).over(Window.partitionBy(key).orderBy(*_order(log, seq)))
    timed = log.withColumn("ms", ms)
    return timed.withColumn("velocity", F.when(F.col("ms") > 0, F.abs(F.col(delta)) / F.col("ms")).otherwise(0.0))


def prefetch(requests: DataFrame, cached: DataFrame, radius: int) -> DataFrame:
    """(vol_id, axis, idx): neighbours within ``radius`` of requests(vol_id, axis, idx, n) that exist and aren't cached."""
    near = requests.select("vol_id", "axis", "n", F.explode(F.sequence(F.col("idx") - radius, F.col("idx") + radius)).alias("near"), "idx")
    wanted = near.where((F.col("near") != F.col("idx")) & F.col("near").between(0, F.col("n") - 1)).select("vol_id", "axis", F.col("near").alias("idx")).distinct()
    return wanted.join(cached.select("vol_id", "axis", "idx"), ["vol_id", "axis", "idx"], "left_anti")


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE) | (status >= 500)


def freshest(log: DataFrame, key: str, seq: str, payload: str) -> DataFrame:
    """Of each key the payload of its latest request; answers to earlier ones are stale."""
    return log.groupBy(key).agg(F.max_by(payload, seq).alias(payload))


def totals(log: DataFrame, group: str, size: str, chunk: str, resident: Column, failed: Column) -> DataFrame:
    """(group, bytes, resident, failures, chunk_bytes): what the caches of each ``group``, such as a host, hold and have seen.

    Sums and counts, combined before they are shuffled. Null sizes count as nothing.
    """
    sums = [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(n) for c, n in ((size, "bytes"), (chunk, "chunk_bytes"))]
    return log.groupBy(group).agg(*sums, F.count_if(resident).alias("resident"), F.count_if(failed).alias("failures"))
