"""Operators on slabs against numpy, on volumes whose sides all differ."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxframe.operators import aggregate, compare, slabwise, voxels

SHAPES = [(7, 5, 3), (4, 9, 11), (1, 1, 1), (2, 1, 13)]


def cubes():
    rng = np.random.default_rng(3)
    out = {k: np.round(rng.normal(0, 10, shape[::-1]), 1).astype(np.float32) for k, shape in enumerate(SHAPES)}
    out[1][0, 0, 0], out[1][5, 2, 1] = np.nan, np.nan
    out[4] = np.full((2, 2, 3), np.nan, np.float32)
    return out


@pytest.fixture(scope="module")
def volumes(spark):
    rows = [(k, c.shape[2], c.shape[1], c.shape[0], c.ravel().tolist()) for k, c in cubes().items()]
    return spark.createDataFrame(rows, "vol_id int, nx int, ny int, nz int, data array<float>").repartition(3)


@pytest.fixture(scope="module")
def slabs(volumes):
    return slabwise.slabs_of(volumes).repartition(5)


def numbers(c):
    return np.sort(c[~np.isnan(c)].astype(float))


def test_slabs_hold_the_volume(slabs):
    got = {}
    for r in slabs.orderBy("vol_id", "z").collect():
        got.setdefault(r.vol_id, []).extend(r.data)
        assert (r.nx, r.ny, r.nz) == cubes()[r.vol_id].shape[::-1]
    for k, c in cubes().items():
        assert np.array_equal(np.array(got[k], np.float32), c.ravel(), equal_nan=True)


def test_ranges(slabs):
    got = {r.vol_id: (r.lo, r.hi) for r in slabwise.value_range(slabs).collect()}
    for k, c in cubes().items():
        v = numbers(c)
        want = (v[0], v[-1] + (v[0] == v[-1])) if len(v) else (None, None)
        assert got[k] == want
    assert slabwise.value_range(slabs.where("vol_id = 9")).count() == 0


@pytest.mark.parametrize("samples", [1, 10, 64, 10_000])
def test_window_equals_that_of_volumes_at_rest(slabs, volumes, samples):
    got = {r.vol_id: tuple(r)[2:] for r in slabwise.auto_window(slabs, samples).collect()}
    want = {r.vol_id: tuple(r)[1:] for r in aggregate.auto_window(volumes, samples).collect()}
    assert got == want and got[4] == (None,) * 4


def test_window_gathers_samples_alone(slabs):
    """A volume of a million voxels, in slabs: what meets in a row are the samples."""
    plan = slabwise.auto_window(slabs)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(s" in plan and "collect_list(data" not in plan and "collect_list(struct" not in plan


@pytest.mark.parametrize("limit", [0, 100])
def test_percentiles_are_exact(slabs, monkeypatch, limit):
    monkeypatch.setattr(slabwise, "BROADCAST_ROWS", limit)
    ps = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    got = {(r.vol_id, r.p): (r.n, r.v) for r in slabwise.percentiles(slabs, ps).collect()}
    want = {}
    for k, c in cubes().items():
        v = numbers(c)
        want |= {(k, p): (len(v), v[min(len(v) - 1, math.floor(len(v) * p))]) for p in ps if len(v)}
    assert got == want


@given(st.lists(st.floats(width=32, allow_nan=True), max_size=30))
def test_bits_are_ordered_as_values(values):
    v = np.array(values, np.float32)
    bits = slabwise.ordered_bits(v)
    good = v[~np.isnan(v)]
    assert np.array_equal(np.sort(good), good[np.argsort(bits, kind="stable")])
    assert [slabwise.from_ordered_bits(int(b)) for b in bits] == good.tolist()


@pytest.mark.parametrize("axis", ["axial", "coronal", "sagittal"])
def test_slices_equal_those_of_volumes_at_rest(slabs, volumes, axis):
    for k in (0, 2, 6):
        got = sorted(str(tuple(r)) for r in slabwise.slice_voxels(slabs, axis, k).drop("t").collect())
        assert got == sorted(str(tuple(r)) for r in voxels.slice_voxels(volumes, axis, k).collect())
    with pytest.raises(ValueError):
        slabwise.slice_voxels(slabs, "oblique", 1)


def test_preview_equals_that_of_volumes_at_rest(slabs, volumes):
    got = sorted(str(tuple(r)) for r in slabwise.preview(slabs).drop("t").collect())
    assert got == sorted(str(tuple(r)) for r in voxels.preview(volumes).collect())


def test_overlay_of_pictures_equals_that_of_pixels(spark):
    rng = np.random.default_rng(5)
    size, other = (7, 5), (3, 2)
    rows = [(k, *size, rng.random(35).tolist(), rng.random(35).tolist()) for k in range(3)]
    others = [(k, *other, rng.random(6).tolist(), rng.random(6).tolist()) for k in (0, 2, 9)]
    schema = "pair int, nx int, ny int, r array<double>, g array<double>"
    first, second = spark.createDataFrame(rows, schema), spark.createDataFrame(others, schema)

    def pixels(df):
        flat = df.select("pair", "nx", F.posexplode(F.arrays_zip("r", "g")).alias("i", "p"))
        return flat.select("pair", F.expr("cast(i % nx as int)").alias("u"), F.expr("cast(i div nx as int)").alias("w"), "p.r", "p.g")

    got = sorted(map(tuple, pixels(compare.overlay_pictures(first, second, 0.3, ("r", "g"))).collect()))
    assert got == sorted(map(tuple, compare.overlay(pixels(first), pixels(second), size, other, 0.3, ("r", "g")).collect()))


def test_pyramid_equals_block_means(slabs):
    got = {(r.vol_id, r.z, r.level): np.array(r.data, np.float32).reshape(r.ny, r.nx) for r in slabwise.pyramid(slabs, 4).collect()}
    for k, c in cubes().items():
        for z, plane in enumerate(c):
            for level in range(5):
                f = 1 << level
                h, w = max(1, plane.shape[0] // f), max(1, plane.shape[1] // f)
                want = np.array([[plane[y * f : (y + 1) * f, x * f : (x + 1) * f].astype(float).mean() for x in range(w)] for y in range(h)], np.float32)
                assert np.allclose(got[k, z, level], want, rtol=1e-6, atol=1e-6, equal_nan=True)
    assert len(got) == 5 * sum(c.shape[0] for c in cubes().values())


@pytest.mark.parametrize("samples", [2, 80])
@pytest.mark.parametrize("turn", [(0.0, 0.0), (0.5, 0.25), (-2.0, 1.1)])
def test_projection_equals_that_of_voxels(slabs, volumes, turn, samples, monkeypatch):
    for module in (slabwise, aggregate):
        monkeypatch.setattr(module, "MIP_SAMPLES", samples)
    headers = volumes.select("vol_id", "nx", "ny", "nz", F.lit(1.0).alias("dx"), (1.0 + F.col("vol_id")).alias("dy"), F.lit(0.5).alias("dz"))
    got = sorted(tuple(r) for r in slabwise.projection(slabs, headers, *turn).drop("t").collect())
    assert got == sorted(tuple(r) for r in aggregate.mip(voxels.voxels(volumes), headers, *turn).collect()) and got


@pytest.mark.parametrize("turn", [(0.0, 0.0), (0.5, 0.25)])
def test_projections_of_volumes_at_rest(volumes, turn):
    """Without a join, filled or not, as by joins; a volume without numbers has null pixels."""
    v = volumes.withColumns({"dx": F.lit(1.0), "dy": 1.0 + F.col("vol_id"), "dz": F.lit(0.5)})
    plain = aggregate.mip(voxels.voxels(v), v, *turn)
    assert sorted(map(tuple, aggregate.volume_mip(v, *turn).collect())) == sorted(map(tuple, plain.collect()))
    filled = {tuple(r)[:3]: r.v for r in aggregate.volume_mip(v, *turn, filled=True).collect()}
    want = {tuple(r)[:3]: r.v for r in aggregate.mip_filled(plain, v, aggregate.value_range(voxels.voxels(v))).collect()}
    assert {k: x for k, x in filled.items() if k[0] != 4} == want and all(x is None for k, x in filled.items() if k[0] == 4)
    assert len(filled) == sum(c.shape[1] * c.shape[2] for c in cubes().values())


def headers(spark, sizes, srow, sform=1):
    plain = {"dx": 1.0, "dy": 2.0, "dz": 0.5, "quatern_b": 0.0, "quatern_c": 0.0, "quatern_d": 0.0, "qoffset_x": 0.0, "qoffset_y": 0.0, "qoffset_z": 0.0, "sform_code": sform, "qform_code": 0}
    rows = [{"vol_id": k, "nx": s[0], "ny": s[1], "nz": s[2], **plain, **{f"srow_{a}": [float(v) for v in r] for a, r in zip("xyz", srow)}} for k, s in sizes.items()]
    return spark.createDataFrame(rows)


AFFINES = {
    "same": [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]],
    "turned": [[0, 1.0, 0, -2.0], [0, 0, -1.0, 6.0], [1.0, 0, 0, 0.5]],
    "sheared": [[0.5, 0.25, 0, -1.0], [0, 2.0, 0.5, 0], [0.25, 0, 0.75, 1.0]],
    "far": [[1.0, 0, 0, 500.0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]],
    "singular": [[1.0, 0, 0, 0], [1.0, 0, 0, 0], [0, 0, 1.0, 0]],
}


@pytest.mark.parametrize("edge", [3, 32])
@pytest.mark.parametrize("affine", sorted(AFFINES))
def test_bricks_find_what_whole_volumes_find(spark, slabs, volumes, affine, edge):
    """Every voxel once, with the value that the comparison of volumes at rest finds, or none; a volume without a partner too."""
    mine = {k: c.shape[::-1] for k, c in cubes().items()}
    pairs = {k: k + 1 for k in range(4)}  # the other volume of 4 is missing
    others = {k: mine[o] for k, o in pairs.items()}
    first, second = headers(spark, mine, AFFINES["same"]), headers(spark, others, AFFINES[affine])
    theirs = volumes.where("vol_id > 0").withColumn("vol_id", F.col("vol_id") - 1)
    found = slabwise.compare(slabs, first, slabwise.slabs_of(theirs), second, edge)
    assert all(len(r.data) <= edge**3 for r in found.collect())
    got = sorted(str(tuple(r)) for r in slabwise.brick_voxels(found).drop("t").collect())
    size = lambda h: h.withColumnRenamed("vol_id", "pair").drop("nx", "ny", "nz")
    whole = compare.compare(volumes.withColumnRenamed("vol_id", "pair"), size(first), theirs.withColumnRenamed("vol_id", "pair"), size(second))
    # The comparison of whole volumes needs both headers; a volume without a partner is all misses.
    want = [str(tuple(r)) for r in whole.collect()]
    c = cubes()[4]
    want += [str((4, x, y, z, float(c[z, y, x]), None)) for z in range(2) for y in range(2) for x in range(3)]
    assert got == sorted(want)


def test_compared_rows_are_small(spark):
    """A brick meets a few of the other volume's, however the volumes are turned."""
    n = 24
    data = np.arange(n**3, dtype=np.float32)
    one = spark.createDataFrame([(0, n, n, n, data.tolist())], "vol_id int, nx int, ny int, nz int, data array<float>")
    c, s = math.cos(0.7), math.sin(0.7)
    turned = [[c, -s, 0.0, 3.0], [s, c, 0.0, -4.0], [0.0, 0.0, 1.0, 0.0]]
    slabs = slabwise.slabs_of(one)
    found = slabwise.compare(slabs, headers(spark, {0: (n,) * 3}, AFFINES["same"]), slabs, headers(spark, {0: (n,) * 3}, turned), 8)
    got = {(r.x, r.y, r.z): r.other for r in slabwise.brick_voxels(found).collect()}
    assert len(got) == n**3
    inverse = np.linalg.inv(np.array(turned)[:, :3])
    for (x, y, z), other in list(got.items())[::7]:
        b = inverse @ (np.array([x, y, z]) - np.array([3.0, -4.0, 0.0]))
        near = np.abs(b - np.floor(b) - 0.5).min() < 1e-6
        i = np.floor(b + 0.5).astype(int)
        inside = ((i >= 0) & (i < n)).all()
        assert near or other == (data[i[0] + n * (i[1] + n * i[2])] if inside else None)


@pytest.mark.parametrize("mode", slabwise.RANGE_MODES)
def test_ranges_of_each_mode(slabs, mode):
    got = {r.vol_id: (r.lo, r.hi) for r in slabwise.value_range(slabs, False, mode, 20).collect()}
    for k, c in cubes().items():
        d, h, w = c.shape
        some = {
            "all": c, "strided": c.ravel()[:: max(1, c.size // 20)], "axial": c[d // 2],
            "middle": np.concatenate([c[d // 2].ravel(), c[:, h // 2].ravel(), c[:, :, w // 2].ravel()]),
        }[mode]
        v = numbers(some)
        assert got[k] == ((v[0], v[-1]) if len(v) else (None, None))
    with pytest.raises(ValueError):
        slabwise.value_range(slabs, mode="other")


@pytest.mark.parametrize("together", [1, 1 << 16])
def test_probe_of_slabs(spark, slabs, together, monkeypatch):
    """Points inside and outside, one of them many times."""
    monkeypatch.setattr(slabwise, "PROBED_ROWS", together)
    points = [(1, 0, x, y, z) for x in range(-1, 5) for y in range(9) for z in (-1, 0, 5, 11)] + [(0, 0, 2, 1, 1)] * 40 + [(9, 0, 0, 0, 0), (0, 1, 0, 0, 0)]
    rows = slabwise.probe(slabs, spark.createDataFrame(points, "vol_id int, t int, x int, y int, z int")).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(points)
    for r in rows:
        c = cubes().get(r.vol_id)
        inside = c is not None and r.t == 0 and 0 <= r.x < c.shape[2] and 0 <= r.y < c.shape[1] and 0 <= r.z < c.shape[0]
        want = float(c[r.z, r.y, r.x]) if inside else None
        assert r.v == want or math.isnan(r.v) and math.isnan(want)


def test_a_load_is_counted_on_its_way(slabs):
    from voxframe.operators import views

    for some in (slabs, slabs.where("vol_id = 99")):
        seen, counts = views.observed(some, "counted")
        n = len(seen.collect())
        assert counts.get["slabs"] == n and counts.get["voxels"] == (sum(c.size for c in cubes().values()) if n else 0)
