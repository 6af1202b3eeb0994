"""Cache entries swept after idle time by the clock, with timers: an entry leaves without any further event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .accesslog import IDLE_SECONDS, SWEEP_SECONDS

#: Seconds for entries of a kind that IDLE_SECONDS doesn't name.
OTHER_SECONDS = max(IDLE_SECONDS.values())
_SCHEMA = "key string, kind string, accesses long, first_ts timestamp, last_ts timestamp"


class _Sweep(StatefulProcessor):
    """Count, first and last use of an entry; one timer at a time looks whether it is idle."""

    def __init__(self, idle: dict[str, float], other: float, sweep: float):
        self.idle, self.other, self.sweep = idle, other, sweep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "accesses long, first long, last long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.entry.get()
        count, first, last, _ = known or (0, None, None, None)
        for part in rows:
            low, high = int(part["ts"].min()), int(part["ts"].max())
            count, first, last = count + len(part), low if first is None else min(first, low), high if last is None else max(last, high)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.entry.update((count, first, last, now))
        if known is None:
            self._look(key, now + self._idle_ms(key))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        count, first, last, used = self.entry.get()
        now, due = timerValues.getCurrentProcessingTimeInMs(), used + self._idle_ms(key)
        if now < due:  # used meanwhile
            self._look(key, due)
            return
        self.entry.clear()
        yield pd.DataFrame({"key": [key[0]], "kind": [key[1]], "accesses": [count], "first_ts": [pd.Timestamp(first, unit="us")], "last_ts": [pd.Timestamp(last, unit="us")]})

    def _idle_ms(self, key) -> int:
        return int(self.idle.get(key[1], self.other) * 1000)

    def _look(self, key, at: int) -> None:
        """Sweeps come at whole multiples of their interval, so timers of many entries fire together."""
        step = max(1, int(self.sweep * 1000))
        self.handle.registerTimer(-(-at // step) * step)

    def close(self) -> None:
        pass


def swept_by_clock(accesses: DataFrame, idle: dict[str, float] | None = None, other: float = OTHER_SECONDS, sweep: float = SWEEP_SECONDS) -> DataFrame:
    """Stream of (key, kind, accesses, first_ts, last_ts): each entry once, when nobody has used it for its kind's idle seconds by the clock.

    ``accesses`` is a stream of (key, kind, ts). Entries are looked at every ``sweep`` seconds; one that is used again later begins anew.
    Kinds that ``idle`` doesn't name, null too, have ``other`` seconds. Null times are left out; a null key is an entry. What is returned of an entry doesn't
    depend on how its accesses fell into batches. The session needs the RocksDB state store, as all streams with timers do.
    """
    keyed = accesses.where("ts IS NOT NULL").select(F.col("key").cast("string"), F.col("kind").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return keyed.groupBy("key", "kind").transformWithStateInPandas(_Sweep(IDLE_SECONDS if idle is None else idle, other, sweep), _SCHEMA, "append", "ProcessingTime")
