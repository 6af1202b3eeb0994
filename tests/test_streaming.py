import datetime as dt
import gzip
import random
import time

import pytest

from voxframe.sources import nifti, nifti_header
from voxframe.streaming import accesslog, idle


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _run(df, name, tmp_path, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_bursts_close_after_gap(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    ms = lambda n: t + dt.timedelta(milliseconds=n)
    rows = [(1, ms(0)), (1, ms(100)), (1, ms(250)), (1, ms(900)), (2, ms(50)), (9, ms(60_000))]
    _write(spark, rows, "key long, ts timestamp", str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ts timestamp").parquet(str(tmp_path / "in"))
    got = sorted((r.key, r.events, r.last_ts) for r in _run(accesslog.bursts(stream, "key"), "bursts", tmp_path, spark))
    assert got == [(1, 1, ms(900)), (1, 3, ms(250)), (2, 1, ms(50))]


def test_idle_entries_are_swept(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    for batch in ([("a", "slice", s(0)), ("a", "slice", s(5)), ("b", "data", s(5))], [("c", "slice", s(150))], [("c", "slice", s(155))]):
        _write(spark, batch, "key string, kind string, ts timestamp", str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(accesslog.swept(stream), "swept", tmp_path, spark)
    gone = {(r.key, r.accesses) for r in got if r.expired}
    assert ("a", 2) in gone and all(k != "c" for k, _ in gone)


def test_volumes_arrive(spark, tmp_path):
    raw = nifti_header.write_header((2, 2, 2), 2) + bytes(range(8))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nii.gz").write_bytes(gzip.compress(raw))
    rows = _run(nifti.decode_files(accesslog.arriving(spark, str(tmp_path / "in"))), "arriving", tmp_path, spark)
    assert sorted(v for r in rows for v in r.data) == list(map(float, range(8)))


def test_unknown_kinds_and_null_times(spark, tmp_path):
    """They don't end the stream: such a kind has the longest idle time, and an access without a time is none."""
    t = dt.datetime(2024, 1, 1)
    for batch in ([("a", "new kind", t), ("b", None, t), ("c", "slice", None)], [("z", "slice", t + dt.timedelta(seconds=1000))], [("z", "slice", t + dt.timedelta(seconds=1001))]):
        _write(spark, batch, "key string, kind string, ts timestamp", str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(accesslog.swept(stream), "unknown", tmp_path, spark)
    assert {(r.key, r.kind) for r in got if r.expired} == {("a", "new kind"), ("b", None)} and all(r.key != "c" for r in got)


@pytest.mark.parametrize("buckets", [1, 7])
def test_entries_share_groups(spark, tmp_path, buckets):
    """120 entries in few groups: state and calls are as many as these, and each entry is used and swept as if it were alone, batch by batch."""
    rng, t = random.Random(3), dt.datetime(2024, 1, 1)
    kinds, limits = ("data", "file_slice", "slice", None), {"data": 120, "file_slice": 60}
    batches = []
    for start in (0, 70, 140, 230, 400, 401):
        batches.append([(rng.choice([None, *range(29)]), rng.choice(kinds), t + dt.timedelta(milliseconds=start * 1000 + rng.randrange(20_000))) for _ in range(90)])
        _write(spark, batches[-1], "key int, kind string, ts timestamp", str(tmp_path / "in"))
    zero, held, want, mark = int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), {}, [], 0
    for rows in [*batches, []]:
        used = set()
        for key, kind, ts in rows:
            entry, ms = (None if key is None else str(key), kind), zero + round((ts - t).total_seconds() * 1000)
            count, last = held.get(entry, (0, 0))
            held[entry] = count + 1, max(last, ms)
            used.add(entry)
        want += [(*e, *held[e], False) for e in used]
        gone = [e for e, (_, last) in held.items() if e not in used and last + 1000 * limits.get(e[1], 90 if e[1] else 120) < mark]
        want += [(*e, *held.pop(e), True) for e in gone]
        mark = max([mark, *(zero + int((ts - t).total_seconds() * 1000) - 30_000 for _, _, ts in rows)])
    stream = spark.readStream.schema("key int, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = accesslog.swept(stream, buckets=buckets).writeStream.format("memory").queryName(f"shared{buckets}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.key, r.kind, r.accesses, r.ms, r.expired) for r in spark.table(f"shared{buckets}").selectExpr("*", "unix_millis(last_ts) AS ms").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[4] for r in got)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= buckets


@pytest.mark.parametrize("files", [1, 100])
def test_entries_leave_by_the_clock_without_new_events(spark, tmp_path, files):
    """Each once, whatever the batches; kinds that aren't named wait longer, and one that comes back is a new entry."""
    t = dt.datetime(2024, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    source = str(tmp_path / "in")
    for batch in ([("a", "slice", s(5)), ("a", "slice", s(0))], [("a", "slice", s(3)), (None, "slice", s(1)), ("late", "unnamed", s(1)), ("n", "slice", None)]):
        _write(spark, batch, "key string, kind string, ts timestamp", source)
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("key string, kind string, ts timestamp").option("maxFilesPerTrigger", files).parquet(source)
        found = idle.swept_by_clock(stream, {"slice": 2}, other=600, sweep=0.5)
        q = found.writeStream.format("memory").queryName(f"clock{files}").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
        table = lambda: sorted(((r.key or "", r.accesses, r.first_ts, r.last_ts) for r in spark.table(f"clock{files}").collect()))
        first = [("", 1, s(1), s(1)), ("a", 3, s(0), s(5))]
        wait_for(lambda: table() == first, q)
        _write(spark, [("a", "slice", s(9))], "key string, kind string, ts timestamp", source)
        wait_for(lambda: table() == [first[0], ("a", 1, s(9), s(9)), first[1]], q)
        q.stop()
    finally:
        spark.conf.unset(name)


def wait_for(true, query):
    end = time.monotonic() + 90
    while not true():
        assert query.exception() is None and time.monotonic() < end
        time.sleep(0.3)
