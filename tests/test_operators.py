import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from voxframe.functions import geometry, intensity, numeric
from voxframe.operators import accesslog, aggregate, voxels


@pytest.fixture(scope="module")
def cube(spark):
    """One volume of 5 x 3 x 7 whose values are its positions."""
    data = [float(i) for i in range(105)]
    return spark.createDataFrame([(1, 5, 3, 7, data)], "vol_id long, nx int, ny int, nz int, data array<float>")


def test_slices_cross_at_one_voxel(cube):
    at = {"axial": (2, 1), "coronal": (2, 4), "sagittal": (1, 4)}
    index = {"axial": 4, "coronal": 1, "sagittal": 2}
    seen = {voxels.slice_voxels(cube, a, k).where(f"u = {at[a][0]} AND w = {at[a][1]}").first().v for a, k in index.items()}
    assert seen == {2 + 5 * (1 + 3 * 4)}


def test_slices_agree_with_voxels(cube):
    vox = voxels.voxels(cube)
    for axis, (u, w, n) in {"axial": ("x", "y", "z"), "coronal": ("x", "z", "y"), "sagittal": ("y", "z", "x")}.items():
        want = sorted((r[0], r[1], r[2]) for r in vox.where(f"{n} = 2").select(u, w, "v").collect())
        assert sorted((r.u, r.w, r.v) for r in voxels.slice_voxels(cube, axis, 2).collect()) == want


def test_out_of_range_and_clamped(cube):
    assert voxels.slice_voxels(cube, "axial", 7).count() == 0
    assert voxels.slice_voxels(cube, "axial", -1).count() == 0
    assert voxels.slice_clamped(cube, "axial", 99).first().idx == 6
    with pytest.raises(ValueError):
        voxels.slice_voxels(cube, "oblique", 1)


def test_slice_is_cut_before_explode(cube):
    plan = voxels.slice_voxels(cube, "axial", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(data" in plan


def test_block_mean_of_factor_one_is_identity(cube):
    s = voxels.slice_voxels(cube, "coronal", 1)
    mean = aggregate.block_mean(s, F.lit(5), F.lit(7), 1)
    assert sorted((r.bx, r.by, r.v) for r in mean.collect()) == sorted((r.u, r.w, r.v) for r in s.collect())
    # Seven is not a multiple of two: the last row of blocks is left out; a short side is one block.
    assert aggregate.block_mean(s, F.lit(5), F.lit(7), 2).count() == 2 * 3
    assert aggregate.block_mean(voxels.slice_voxels(cube, "axial", 0), F.lit(5), F.lit(3), 4).count() == 1


def test_ranges_skip_nan_and_widen(spark):
    rows = [(1, 2, 1, 1, [math.nan, 5.0]), (2, 2, 1, 1, [1.0, 4.0])]
    v = spark.createDataFrame(rows, "vol_id long, nx int, ny int, nz int, data array<float>")
    got = {r.vol_id: (r.lo, r.hi) for r in aggregate.value_range(voxels.voxels(v)).collect()}
    assert got == {1: (5.0, 6.0), 2: (1.0, 4.0)}
    assert {r.vol_id: (r.lo, r.hi) for r in aggregate.strided_range(v).collect()} == got


def test_unrotated_projection_is_maximum_over_z(cube):
    header = cube.withColumns({c: F.lit(1.0) for c in ("dx", "dy", "dz")})
    got = sorted((r.px, r.py, r.v) for r in aggregate.mip(voxels.voxels(cube), header).collect())
    # Half of an odd side rounds up, so pixels lie where voxels do.
    want = sorted((x, y, float(x + 5 * (y + 3 * 6))) for x in range(5) for y in range(3))
    assert got == want


def test_half_up_and_defaults(spark):
    row = spark.range(1).select(numeric.half_up(F.lit(-0.5)).alias("a"), numeric.half_up(F.lit(2.5)).alias("b"), numeric.or_default(F.lit(float("nan")), 1.0).alias("c"), numeric.or_default(F.lit(0.0), 1.0).alias("d")).first()
    assert tuple(row) == (0, 3, 1.0, 1.0)


def test_colour_table_ends_at_its_stops(spark):
    for name, stops in intensity.STOPS.items():
        table = {r.k: (r.r, r.g, r.b) for r in intensity.colour_table(spark, name).collect()}
        assert len(table) == 256 and table[0] == stops[0][1:] and table[255] == stops[-1][1:]
    with pytest.raises(ValueError):
        intensity.apply_colormap(spark.range(1).withColumn("t", F.lit(0.5)), "none")


def test_scale_bar_of_pixels_without_size(spark, tmp_path, same_rows):
    """The query on events with the value zero, of either sign, and on other odd ones, against its SQL; such rows end no job."""
    import duckdb

    from voxframe.plans import log_queries

    values = [0.0, -0.0, 0.5, -3.0, None, math.inf, 1e-320, 560.21]
    spark.createDataFrame([(k, v) for k, v in enumerate(values)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    sql = log_queries.SQL["q37_scale_bar"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    got = log_queries.scale_bar(spark, str(tmp_path))
    same_rows(got.toPandas(), duckdb.sql(sql).df())
    assert {r.event_id: r.bar_px for r in got.where("event_id < 2").collect()} == {0: math.inf, 1: -math.inf}


def test_scale_bar_is_rounded_as_in_sql(spark, tmp_path, same_rows):
    """Bars whose seventh decimal is a five, very long, very short and negative ones, against the SQL: the same doubles, with the sign of a zero."""
    import duckdb

    from voxframe.plans import log_queries

    odd = [(200091, 87.96115154693393), (200209, 918.9188154370704), (200248, 2952.362015087456), (2, 1.2505243096762926e-07), (208, 7.935987396215892e-12), (600025, 5.4351284714482324e-105)]
    values = [*odd, (1, 1e-303), (3, -1e9), (4, -1e300), (5, -math.inf), (6, -7.0), (7, math.nan), (8, None), (9, 0.0), (10, 560.21)]
    spark.createDataFrame(values, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    sql = log_queries.SQL["q37_scale_bar"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = log_queries.scale_bar(spark, str(tmp_path)).toPandas(), duckdb.sql(sql).df()
    same_rows(got, want)
    got, want = ({r.event_id: math.copysign(1, r.bar_px) for r in t.itertuples() if r.bar_px == 0} for t in (got, want))
    assert got == want and -1 in got.values()


def _header(spark, **more):
    base = {"x": 1, "y": 2, "z": 3, "dx": 2.0, "dy": 3.0, "dz": 4.0, "qfac": -1.0, "sform_code": 0, "qform_code": 0, "quatern_b": 0.1, "quatern_c": 0.2, "quatern_d": 0.3, "qoffset_x": 1.0, "qoffset_y": 2.0, "qoffset_z": 3.0}
    rows = {"srow_x": [1.0, 0.5, 0.0, 2.0], "srow_y": [0.0, 2.0, 0.25, -1.0], "srow_z": [0.5, 0.0, 3.0, 4.0]}
    return spark.createDataFrame([base | rows | more])


@pytest.mark.parametrize("more", [{}, {"sform_code": 1}, {"qform_code": 1}])
def test_standard_world_and_back(spark, more):
    df = _header(spark, **more)
    w = geometry.to_world(F.col("x"), F.col("y"), F.col("z"), mode="standard")
    df = df.withColumns(dict(zip(("wx", "wy", "wz"), w)))
    back = df.select(*geometry.to_voxel(F.col("wx"), F.col("wy"), F.col("wz"), mode="standard")).first()
    assert [round(v, 9) for v in back] == [1, 2, 3]


def test_lru_keeps_pinned_and_newest(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", 60, t, False), ("b", 60, t + dt.timedelta(1), False), ("c", 500, t, True), ("d", 40, t + dt.timedelta(2), False)]
    entries = spark.createDataFrame(rows, "key string, bytes long, last_ts timestamp, pinned boolean").withColumn("host", F.lit("h"))
    kept = {r.key: r.kept for r in accesslog.lru_within_budget(entries, "key", "host", 600).collect()}
    assert kept == {"c": True, "d": True, "b": True, "a": False}
    assert {r.key for r in accesslog.newest(entries, "key", "host", 2).where("kept").collect()} == {"c", "d"}


def test_scroll_of_close_events(spark, tmp_path, same_rows):
    """Events of a user a millisecond apart: the query counts each step once, as its SQL does; the operator counts fast ones twice."""
    import duckdb

    from voxframe.plans import log_queries

    t = dt.datetime(2024, 1, 1)
    rows = [(k * 7, k % 3, t + dt.timedelta(microseconds=k * 300)) for k in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    sql = log_queries.SQL["q49_scroll"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    same_rows(log_queries.scroll(spark, str(tmp_path)).toPandas(), duckdb.sql(sql).df())
    # 70 units in 1 ms are fast, in 100 ms they aren't.
    wheel = spark.createDataFrame([("k", t + dt.timedelta(milliseconds=m), 70) for m in (0, 1, 2, 102)], "key string, ts timestamp, d int")
    moved = [accesslog.scrolled(wheel, "key", "d", fast_at=f).first().moved for f in (2.0, None)]
    assert moved == [1 + 2 + 2 + 1, 4]


def test_thumbnail_of_a_large_slice_keeps_its_corners(spark):
    """More voxels than pixels: some voxels have no pixel, each pixel has one voxel."""
    from voxframe.operators import views

    v = spark.createDataFrame([(1, 7, 5, 1, [float(i) for i in range(35)])], "vol_id long, nx int, ny int, nz int, data array<float>")
    got = {(r.mx, r.my): r.r for r in views.thumbnail(v, size=3).collect()}
    assert len(got) == 9
    assert got[0, 0] == math.floor(28 / 34 * 255 + 0.5) and got[2, 2] == math.floor((4 + 7) / 34 * 255 + 0.5)


def test_slice_bytes_are_row_major(spark, cube):
    import numpy as np

    from voxframe.operators import views

    payload = views.slice_bytes(voxels.slice_voxels(cube, "coronal", 1)).first().payload
    assert np.frombuffer(payload, "<f4").tolist() == [float(x + 5 * (1 + 3 * z)) for z in range(7) for x in range(5)]


def test_debounce_and_admission(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, t + dt.timedelta(milliseconds=m)) for m in (0, 100, 281, 462, 700)], "key long, ts timestamp")
    kept = sorted(r.ts.microsecond // 1000 for r in accesslog.debounced(log, "key").collect())
    assert kept == [100, 281, 462, 700]
    jobs = spark.createDataFrame([("remote", 1, 1), ("remote", 5, 2), ("local", 0, 3), ("local", 0, 4), ("local", 0, 5)], "class string, priority int, seq int")
    assert sorted(r.seq for r in accesslog.admitted(jobs.withColumn("host", F.lit("h")), "host").where("active").collect()) == [2, 3, 4]


def test_strided_window_of_a_large_volume_skips_nan(spark):
    """More voxels than samples, a tenth of them NaN: the strided samples are sorted and picked as by hand."""
    n = 25_000
    data = [math.nan if i % 10 == 0 else float(i * 7919 % 10_007) for i in range(n)]
    v = spark.createDataFrame([(1, 50, 50, 10, data), (2, 1, 1, 1, [math.nan])], "vol_id long, nx int, ny int, nz int, data array<float>")
    got = {r.vol_id: r for r in aggregate.auto_window(v).collect()}
    step = n // aggregate.CONTRAST_SAMPLES
    assert step == 2
    samples, whole = sorted(x for x in data[::step] if x == x), [x for x in data if x == x]
    low, high = samples[int(len(samples) * 0.01)], samples[int(len(samples) * 0.99)]
    assert (got[1].p01, got[1].p99) == (low, high) and got[1].win == (high - low) / (max(whole) - min(whole))
    assert got[2].p01 is None and got[2].win is None


def test_strided_projection(spark):
    """Sides of twice the samples: every other voxel counts."""
    n = 2 * aggregate.MIP_SAMPLES
    v = spark.range(1).select(F.col("id").alias("vol_id"), F.lit(n).alias("nx"), F.lit(n).alias("ny"), F.lit(n).alias("nz"), *[F.lit(1.0).alias(c) for c in ("dx", "dy", "dz")])
    axis = spark.range(n).select(F.col("id").cast("int").alias("k"))
    near = axis.where("k IN (0, 1, 40, 41, 158, 159)")
    vox = near.select(F.col("k").alias("x")).join(near.select(F.col("k").alias("y"))).join(near.select(F.col("k").alias("z"))).withColumn("vol_id", F.lit(0).cast("long"))
    vox = vox.withColumn("v", (F.col("x") + 1000 * F.col("z")).cast("float"))
    got = {(r.px, r.py): r.v for r in aggregate.mip(vox, v).collect()}
    even = (0, 40, 158)
    assert got == {(x, y): float(x + 158_000) for x in even for y in even}


def test_zoom_in_parts_is_zoom_step_by_step(spark, monkeypatch):
    import random

    rng = random.Random(2)
    t = dt.datetime(2024, 1, 1)
    rows = [(k, t + dt.timedelta(seconds=n), rng.choice([0.5, 0.8, 1.1, 1.3, 2.0])) for k in range(3) for n in range(57)]
    want = {}
    for k, _, f in rows:
        want[k] = max(0.5, min(10.0, want.get(k, 1.0) * f))
    log = spark.createDataFrame(rows, "key long, ts timestamp, f double")
    for size in (1, 10, 1000):
        monkeypatch.setattr(accesslog, "FOLD_ROWS", size)
        got = {r.key: r.zoom for r in accesslog.zoomed(log, "key", "f").collect()}
        assert got == pytest.approx(want)


def test_equal_times_have_one_order(spark):
    """However the rows are dealt, by a number of their own or without one."""
    t = dt.datetime(2024, 1, 1)
    rows = [("k", k, t + dt.timedelta(milliseconds=100 * (k // 3)), 1000 * (k % 5 + 1), k % 4 + 1, k * 7 % 31 - 15, (0.5, 2.0, 3.0)[k % 3]) for k in range(24)]
    schema = "key string, n int, ts timestamp, bytes long, ms int, d int, f double"
    found = {}
    for seq in ("n", None):
        for order in (rows, rows[::-1], rows[7:] + rows[:7]):
            log = spark.createDataFrame(order, schema).repartition(3)
            got = (
                sorted((r.n, r.bps) for r in accesslog.bandwidth(log, "key", seq).collect()),
                sorted(r.n for r in accesslog.debounced(log, "key", 50, seq).collect()),
                sorted((r.n, r.sum_d) for r in accesslog.panned(log, "key", "d", seq=seq).collect()),
                accesslog.zoomed(log, "key", "f", seq).first().zoom,
                accesslog.scrolled(log, "key", "d", seq=seq).first().moved,
                sorted((r.n, r.ms) for r in accesslog.velocity(log, "key", "d", seq).collect() if r.ms is not None),
            )
            assert found.setdefault(seq, got) == got
    assert found["n"][1] == [2, 5, 8, 11, 14, 17, 20, 23]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_iso_text_in_any_time_zone(spark, zone):
    from voxframe.functions import times

    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-07-01 05:06:07.89', TIMESTAMP '2024-07-01 05:06:07.8919Z'), (TIMESTAMP_NTZ '0999-12-31 00:00:00', TIMESTAMP '1969-12-31 23:59:59.9999Z'), (NULL, NULL) AS t(a, b)")
        got = [tuple(r) for r in rows.select(times.iso_text(F.col("a")), times.iso_text(F.col("b"))).collect()]
        assert got == [("2024-07-01T05:06:07.890Z", "2024-07-01T05:06:07.891Z"), ("0999-12-31T00:00:00.000Z", "1969-12-31T23:59:59.999Z"), (None, None)]
        texts = spark.createDataFrame([("2024-07-01T05:06:07.891Z",), ("2024-07-01",), ("x",), (None,)], "s string")
        assert [r[0] for r in texts.select(F.unix_millis(times.from_iso(F.col("s")))).collect()] == [1719810367891, None, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
