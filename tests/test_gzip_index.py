"""Entering gzipped files in the middle."""

import gzip
import zlib

import numpy as np
import pytest

from voxframe.sources import gzip_index, nifti, nifti_header

SHAPE = (64, 60, 50)


def content():
    rng = np.random.default_rng(2)
    values = (np.arange(np.prod(SHAPE)) // 7 + rng.integers(0, 50, np.prod(SHAPE))).astype("<i2")
    return nifti_header.write_header(SHAPE, 4) + values.tobytes(), values.astype(np.float32)


def packed(raw, kind):
    if kind == "members":
        return b"".join(gzip.compress(raw[k : k + 70_000]) for k in range(0, len(raw), 70_000))
    if kind == "padded":
        return gzip.compress(raw) + bytes(1000)
    if kind == "stored":
        return gzip.compress(raw, 0)
    if kind == "named":
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(raw[:5000]) + c.flush(zlib.Z_FULL_FLUSH) + c.compress(raw[5000:]) + c.flush()
    return gzip.compress(raw, int(kind))


KINDS = ["1", "6", "9", "members", "padded", "stored", "named"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("span", [40_000, 1 << 30])
def test_every_place_gives_the_content_from_there(tmp_path, kind, span):
    raw, _ = content()
    path = str(tmp_path / "v.nii.gz")
    (tmp_path / "v.nii.gz").write_bytes(packed(raw, kind))
    points, size = gzip_index.build(path, span)
    assert size == len(raw) and points[0][:3] == (0, 0, 0) and len(points) == 1 if span > size else len(points) > 1
    for p in points:
        source = gzip_index.Entered(path, p)
        assert source.read(p.out + 10, 5000) == raw[p.out + 10 : p.out + 5010]
        assert source.read(p.out + 90_000, 1 << 30) == raw[p.out + 90_000 :]
        source.close()


@pytest.mark.parametrize("change", ["cut", "checksum", "flipped", "no gzip", "empty"])
def test_the_index_pass_finds_damage(tmp_path, change):
    good = packed(content()[0], "6")
    bad = bytearray(good)
    bad[-6 if change == "checksum" else len(bad) // 2] ^= 0xFF
    raw = {"cut": good[:-20], "no gzip": content()[0], "empty": b""}.get(change, bytes(bad))
    (tmp_path / "v.nii.gz").write_bytes(raw)
    with pytest.raises(nifti.Unreadable):
        gzip_index.build(str(tmp_path / "v.nii.gz"), 40_000)


def test_volumes_are_read_by_several_tasks(spark, tmp_path):
    raw, values = content()
    for name in KINDS:
        (tmp_path / f"{name}.nii.gz").write_bytes(packed(raw, name))
    (tmp_path / "bad.nii.gz").write_bytes(packed(raw, "6")[:-5])
    (tmp_path / "text.nii.gz").write_bytes(gzip.compress(b"no volume" * 100))
    files = spark.createDataFrame([(p, ) for p, _ in nifti.listed(str(tmp_path), "*.gz")], "path string")
    gzip_index.gzip_index(files, span=50_000).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.where("error IS NOT NULL").count() == 2 and index.where("size(points) > 3").count() == len(KINDS)
    planes = values.reshape(SHAPE[::-1])
    slabs = gzip_index.read_indexed(index)
    tasks = slabs.rdd.glom().map(lambda rows: len({r.path for r in rows})).collect()
    assert sum(tasks) > len(KINDS)  # a file is in several partitions
    rows = slabs.collect()
    assert sorted((r.path, r.z) for r in rows) == sorted((p.path, z) for p in index.where("error IS NULL").collect() for z in range(SHAPE[2]))
    assert all(np.array_equal(np.array(r.data, np.float32), planes[r.z].ravel()) for r in rows)
    some = gzip_index.read_indexed(index, "voxels", z=(20, 22), y=(5, 6)).collect()
    assert len(some) == len(KINDS) * 2 * SHAPE[0] and all(r.v == planes[r.z, r.y, r.x] for r in some)


def test_one_slab_takes_about_one_span(spark, tmp_path, monkeypatch):
    raw, _ = content()
    (tmp_path / "v.nii.gz").write_bytes(packed(raw, "6"))
    span = 40_000
    points, _ = gzip_index.build(str(tmp_path / "v.nii.gz"), span)
    h = nifti.read_header(str(tmp_path / "v.nii.gz"))
    slab = h["slice_size"] * 2
    made, step = [0], gzip_index.Inflater.step

    def counted(self, most, flush):
        part, ended = step(self, most, flush)
        made[0] += len(part)
        return part, ended

    monkeypatch.setattr(gzip_index.Inflater, "step", counted)
    monkeypatch.setattr(gzip_index, "INPUT_BYTES", 1 << 10)
    for z in (3, 25, 49):
        start = h["vox_offset"] + z * slab
        point = max((p for p in points if p.out <= start), key=lambda p: p.out)
        made[0] = 0
        source = gzip_index.Entered(str(tmp_path / "v.nii.gz"), point)
        assert source.read(start, slab) == raw[start : start + slab]
        assert made[0] <= 2.5 * span + slab < len(raw) / 2
        source.close()
