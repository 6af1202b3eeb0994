import gzip
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.sources import nifti, nifti_header, preview_codec

SHAPE = (5, 3, 7)


def volume(code, version=1, order="<", shape=SHAPE, frames=1, **fields):
    n = int(np.prod(shape)) * frames
    values = (np.arange(n) % 100).astype(order + nifti.DTYPES[code])
    dims = shape if frames == 1 else (*shape, frames)
    return nifti_header.write_header(dims, code, version, order, **fields) + values.tobytes(), values.astype(np.float32)


@pytest.mark.parametrize("code", sorted(nifti.DTYPES))
@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("version", [1, 2])
def test_decode_every_number_type(code, order, version):
    raw, values = volume(code, version, order)
    h = nifti_header.parse_header(raw)
    assert (h["version"], h["nx"], h["ny"], h["nz"], h["little_endian"]) == (version, *SHAPE, order == "<")
    assert np.array_equal(nifti.decode(raw[h["vox_offset"] :], h, h["total_voxels"]), values)


def test_header_defaults():
    raw, _ = volume(16, pixdim=[0, -2.0, 0.0, math.nan, math.nan, 1, 1, 1], scl_slope=0.0, scl_inter=math.nan, vox_offset=0)
    h = nifti_header.parse_header(raw)
    assert (h["dx"], h["dy"], h["dz"], h["dt"], h["scl_slope"], h["scl_inter"], h["vox_offset"]) == (2, 1, 1, 0, 1, 0, 352)
    assert h["orientation"] == "RAS"


@pytest.mark.parametrize("raw", [b"", bytes(347), bytes(600)])
def test_not_nifti(raw):
    with pytest.raises(nifti_header.NotNifti):
        nifti_header.parse_header(raw)


def test_version_2_places_differ_by_mode():
    raw, _ = volume(16, 2, sform_code=1, srow_x=[2, 0, 0, 1], srow_y=[0, 3, 0, 1], srow_z=[0, 0, 4, 1], pixdim=[1, 2, 3, 4, 5, 1, 1, 1])
    h = nifti_header.parse_header(raw)
    assert (h["sform_code"], h["srow_z"], h["dx"], h["dt"]) == (1, [0, 0, 4, 1], 2, 5)
    assert nifti_header.parse_header(raw, mode="reference")["dx"] == 1


def test_orientation_of_known_and_unknown_rows():
    assert nifti_header.orientation_code([(1, 0, 0), (0, 1, 0), (0, 0, 1)]) == "RAS"
    assert nifti_header.orientation_code([(-1, 0, 0), (0, -1, 0), (0, 0, 1)]) == "LPS"
    assert nifti_header.orientation_code([(1, 1, 0), (1, 0, 0), (0, 0, 1)]) == "unknown"


def test_byte_ranges():
    h = nifti_header.parse_header(volume(4)[0])
    assert nifti_header.slice_byte_range(h, "axial", 2) == (352 + 2 * 30, 352 + 3 * 30 - 1)
    assert nifti_header.slice_byte_range(h, "coronal", 2) is None
    assert nifti_header.frame_byte_range(h, 1) == (352 + 210, 352 + 419)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("volumes")
    raw, _ = volume(4, scl_slope=2.0, scl_inter=10.0)
    (d / "a.nii").write_bytes(raw)
    (d / "b.nii.gz").write_bytes(gzip.compress(raw))
    (d / "c.nii").write_bytes(volume(16, 2, ">", frames=2)[0])
    (d / "bad.txt").write_bytes(b"no")
    return d


@pytest.mark.parametrize("pushed", ["false", "true"])
def test_read_voxels_with_filters_pushed_or_not(spark, folder, pushed):
    nifti.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    try:
        check_filters(spark, folder, pushed)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def check_filters(spark, folder, pushed):
    vox = spark.read.format("nifti").option("slabBytes", "60").option("pushdown", pushed).load(str(folder))
    assert vox.count() == 105 * 4
    one = vox.where("z = 2 AND path LIKE '%a.nii'")
    assert one.count() == 15
    row = one.where("x = 4 AND y = 1").collect()[0]
    assert row.v == 2 * ((4 + 5 * 1 + 15 * 2) % 100) + 10
    same = vox.groupBy("path").agg(F.sum("v").alias("s")).collect()
    sums = {r.path.rsplit("/")[-1]: r.s for r in same}
    assert sums["a.nii"] == sums["b.nii.gz"]
    assert vox.where("t = 1").select("path").distinct().count() == 1
    assert vox.where("z >= 5 AND z < 3").count() == 0


def test_reader_cuts_partitions(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = nifti.NiftiReader(None, {"path": str(folder), "slabbytes": "60"})
    assert list(reader.pushFilters([EqualTo(("z",), 2), EqualTo(("v",), 1.0), GreaterThan(("t",), 0)])) == [EqualTo(("v",), 1.0)]
    # The filters leave one slab, in one of the parts that the file's size makes.
    (c,) = [f[0] for p in reader.partitions() for f in p.files if f[0].endswith("c.nii") and f[1] == 0]
    h = nifti.read_header(c)
    assert [r for p in reader.partitions() for f in p.files if f[0] == c for r in p.ranges(h, *f[1:])] == [(1, 2, 3)]
    # 1384 bytes are three parts; a file of 562 bytes is one, and so is a gzipped one.
    whole = nifti.NiftiReader(None, {"path": str(folder), "slabbytes": "600"}).partitions()
    assert [[(f[0][-5:], *f[1:]) for f in p.files] for p in whole] == [[("a.nii", 0, 1)], [("c.nii", 0, 3)], [("c.nii", 1, 3)], [("c.nii", 2, 3)], [("ii.gz", 0, 1)]]
    assert [len(p.files) for p in nifti.NiftiReader(None, {"path": str(folder)}).partitions()] == [3]


@pytest.mark.parametrize("parts", [1, 2, 5, 100])
def test_parts_of_a_file_hold_each_slab_once(parts):
    whole = nifti.Parts([], (1, 6), (1, 4))
    seen = [(t, z) for k in range(parts) for t, low, high in whole.ranges({"nz": 7, "nt": 9}, k, parts) for z in range(low, high)]
    assert seen == [(t, z) for t in range(1, 4) for z in range(1, 6)]


def test_patterns_and_uris(spark, folder):
    nifti.register(spark)
    one = {nifti.listed(p, "*.nii*")[0] for p in (f"{folder}/a.*", f"file://{folder}/a.nii", f"file:{folder}/a.nii", str(folder / "a.nii"))}
    assert one == {(str(folder / "a.nii"), (folder / "a.nii").stat().st_size)}
    assert len(nifti.listed(f"{folder}/*.nii*", "*")) == 3 and nifti.listed(f"{folder}/none*", "*") == []
    with pytest.raises(FileNotFoundError):
        nifti.listed(f"{folder}/none", "*")
    assert spark.read.format("nifti").load(f"file://{folder}").count() == 105 * 4


def test_files_behind_http_are_read_by_range(folder):
    """A server that knows ranges is asked for the header and one slab only; one that doesn't sends all, with the same result."""
    import functools
    import http.server
    import threading

    asked = []

    class Handler(http.server.SimpleHTTPRequestHandler):
        ranges = True

        def do_GET(self):
            raw = (folder / self.path.lstrip("/")).read_bytes()
            sent, status = raw, 200
            if self.ranges and self.headers.get("Range"):
                low, high = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
                sent, status = raw[low : high + 1], 206
            asked.append(len(sent))
            self.send_response(status)
            self.send_header("Content-Length", str(len(sent)))
            self.end_headers()
            self.wfile.write(sent)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Handler, directory=str(folder)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for name, ranges in (("a.nii", True), ("a.nii", False), ("b.nii.gz", True)):
            Handler.ranges, asked[:] = ranges, []
            reader = nifti.NiftiReader(None, {"path": f"http://127.0.0.1:{server.server_port}/{name}", "view": "slabs"})
            reader.bounds["z"] = (2, 3)
            (batch,) = [b for p in reader.partitions() for b in reader.read(p)]
            assert batch.column("z").to_pylist() == [2] and batch.column("data")[0].as_py() == [2.0 * ((30 + k) % 100) + 10 for k in range(15)]
            assert not ranges or name.endswith("gz") or asked[1] == 30
    finally:
        server.shutdown()


def test_batches_gather_slabs(folder, monkeypatch):
    reader = nifti.NiftiReader(None, {"path": str(folder), "view": "slabs"})
    (partition,) = reader.partitions()
    (batch,) = reader.read(partition)
    assert batch.num_rows == 7 * 4
    monkeypatch.setattr(nifti, "BATCH_VOXELS", 40)
    parts = list(reader.read(partition))
    assert len(parts) > 7 and sum((b.to_pylist() for b in parts), []) == batch.to_pylist()


def test_header_view_and_json(spark, folder):
    nifti.register(spark)
    headers = spark.read.format("nifti").option("view", "header").option("pathGlobFilter", "*").load(str(folder))
    assert headers.where("error IS NULL").count() == 3
    texts = {r.path.rsplit("/")[-1]: r.json for r in nifti_header.header_json(headers).collect()}
    assert '"nx":5' in texts["a.nii"] and '"error"' in texts["bad.txt"]


def test_binary_files_decode_alike(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder))
    parsed = nifti_header.parse_headers(files)
    assert {r.error is None for r in parsed.where("path LIKE '%.nii'").collect()} == {True}
    slabs = nifti.decode_files(files, damaged="skip")
    assert slabs.select("path").distinct().count() == 3
    assert slabs.count() == 7 * 4
    assert slabs.where("path LIKE '%a.nii' AND z = 1").first().data[0] == 2 * 15 + 10


def test_truncated_file_reads_as_zero():
    raw, values = volume(4)
    h = nifti_header.parse_header(raw)
    got = nifti.decode(raw[352 : 352 + 101], h, 105)
    assert np.array_equal(got[:50], values[:50]) and not got[50:].any()


def test_colour_types_are_refused():
    h = nifti_header.parse_header(nifti_header.write_header(SHAPE, 128))
    with pytest.raises(ValueError):
        nifti.decode(bytes(400), h, 105)


def test_preview_payload_layout():
    parts = [np.arange(1, 5), np.arange(5, 9), np.arange(9, 13)]
    raw = preview_codec.encode('{"nx":4}', 1, 12, [1, 1, 2], parts)
    assert struct.unpack_from("<I", raw)[0] == 8
    header, lo, hi, idx, slices = preview_codec.decode(raw)
    assert (header, lo, hi, idx) == ('{"nx":4}', 1, 12, [1, 1, 2])
    assert [s.tolist() for s in slices] == [p.tolist() for p in parts]


def test_volumes_feed_the_operators(spark, folder):
    from voxframe.operators import aggregate, voxels

    slabs = nifti.read_volumes(spark, [str(folder / "a.nii"), str(folder / "b.nii.gz")])
    volumes = nifti.as_volumes(slabs)
    assert volumes.count() == 2
    got = {(r.lo, r.hi) for r in aggregate.value_range(voxels.voxels(volumes)).collect()}
    assert got == {(10.0, 208.0)}
    assert nifti.slab_voxels(slabs).where("x = 4 AND y = 1 AND z = 2").select("v").distinct().first().v == 2 * (4 + 5 + 30) + 10


def test_preview_as_json(spark, tmp_path):
    import json

    rows = [("p", '{"nx":4}', 1.0, 12.0, [1, 1, 2], [1.0, 2.0], [3.0], [4.0])]
    previews = spark.createDataFrame(rows, preview_codec.PREVIEW)
    full, part = (json.loads(preview_codec.preview_json(previews, p).first().json) for p in (False, True))
    assert full["header"] == {"nx": 4} and full["coronal"] == [3.0] and "partialPreview" not in full
    assert part["coronal"] == [0.0] and part["axial"] == [1.0, 2.0] and part["partialPreview"]
    preview_codec.write_json(preview_codec.preview_json(previews), str(tmp_path / "out"))
    assert any(p.suffix == ".gz" for p in (tmp_path / "out").iterdir())
    back = preview_codec.decode_previews(preview_codec.encode_previews(previews)).first()
    assert back.sagittal == [4.0] and back.idx == [1, 1, 2]


def test_tagged_jobs_can_be_cancelled(spark):
    import threading

    from voxframe import session

    failed = []

    def work():
        with session.cancellable(spark, "slow"):
            try:
                spark.range(10_000_000_000).selectExpr("sum(hash(id))").collect()
            except Exception as e:
                failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(60):
        session.cancel(spark, "slow")
        thread.join(0.5)
        if not thread.is_alive():
            break
    assert failed


def test_one_frame_scanned_twice_keeps_all_rows(spark, folder):
    """Spark has one reader for both scans; without pushdown neither scan's filter is the other's."""
    slabs = nifti.read_volumes(spark, str(folder))
    assert sorted(r.z for r in slabs.where("z = 1").union(slabs.where("z = 2")).collect()) == [1] * 4 + [2] * 4


def test_bounds_by_option(spark, folder):
    path = str(folder / "a.nii")
    vox = nifti.read_volumes(spark, path, "voxels", x="1:3", y="2", z=":4")
    want = nifti.read_volumes(spark, path, "voxels").where("x BETWEEN 1 AND 2 AND y = 2 AND z < 4")
    assert sorted(map(tuple, vox.collect())) == sorted(map(tuple, want.collect())) and vox.count() == 8
    assert nifti.read_volumes(spark, path, "voxels", x="9").count() == 0
    with pytest.raises(Exception, match="no bounds of x"):
        nifti.read_volumes(spark, path, "slabs", x="1").count()


@pytest.mark.parametrize("name", ["a.nii", "b.nii.gz", "c.nii"])
@pytest.mark.parametrize("merged", [0, 8, 1 << 20])
def test_bounded_cubes_equal_whole_ones(folder, name, merged, monkeypatch):
    """Any bounds, with runs of bytes read one by one, partly or wholly together."""
    monkeypatch.setattr(nifti, "MERGED_BYTES", merged)
    monkeypatch.setattr(nifti, "READ_BYTES", 64 if merged == 8 else 1 << 20)
    monkeypatch.setattr(nifti, "BATCH_VOXELS", 20)
    path = str(folder / name)
    whole = {}
    for b in nifti.Scan("voxels").read([(path, 0, 1)]):
        whole |= {(r["t"], r["x"], r["y"], r["z"]): r["v"] for r in b.to_pylist()}
    for bounds in ({"y": (1, 2)}, {"x": (4, 5)}, {"x": (1, 3), "y": (0, 2), "z": (2, 6)}, {"x": (3, 9), "t": (0, 1)}):
        scan = nifti.Scan("voxels")
        for axis, (low, high) in bounds.items():
            scan.within(axis, low, high)
        got = [((r["t"], r["x"], r["y"], r["z"]), r["v"]) for b in scan.read([(path, 0, 1)]) for r in b.to_pylist()]
        want = {k: v for k, v in whole.items() if all(low <= dict(zip("txyz", k))[a] < high for a, (low, high) in bounds.items())}
        assert len(got) == len(want) and dict(got) == want


def test_a_coronal_plane_reads_its_rows_only(tmp_path, monkeypatch):
    raw, _ = volume(4, shape=(100, 90, 80))
    (tmp_path / "v.nii").write_bytes(raw)
    read, plain = [], nifti.Plain.read
    monkeypatch.setattr(nifti.Plain, "read", lambda self, start, size: read.append(size) or plain(self, start, size))
    for axis, most in (("y", 100 * 80 * 2), ("x", 90 * 80 * 100 * 2)):
        read.clear()
        scan = nifti.Scan("voxels")
        scan.within(axis, 7, 8)
        assert sum(b.num_rows for b in scan.read([(str(tmp_path / "v.nii"), 0, 1)])) == (8000 if axis == "y" else 7200)
        assert sum(read[1:]) <= most
    assert len(read) < 5  # columns of near rows are read along


def damaged_files():
    """Name, bytes and what the error says; good ones have none."""
    raw, _ = volume(4)
    zipped = gzip.compress(raw)
    flipped, wrong = bytearray(zipped), bytearray(zipped)
    flipped[len(zipped) // 2] ^= 0xFF
    wrong[-6] ^= 1  # in the checksum
    return [
        ("good.nii", raw, None), ("good.nii.gz", zipped, None), ("cut.nii", raw[:-1], "bytes of"), ("cut.nii.gz", zipped[: len(zipped) // 2], "gzip"), ("flipped.nii.gz", bytes(flipped), "gzip"),
        ("checksum.nii.gz", bytes(wrong), "gzip"), ("short.nii.gz", gzip.compress(raw[:-10]), "bytes of"), ("empty.nii", b"", "too few"), ("text.nii", b"no volume " * 100, "neither"), ("plain.nii.gz", raw, "gzip"),
        ("colours.nii", nifti_header.write_header(SHAPE, 128) + bytes(315), "aren't numbers"), ("magic.nii", raw[:344] + b"abcd" + raw[348:], "magic"), ("pair.nii", raw[:344] + b"ni1\0" + raw[348:], ".img"),
        ("lone.hdr", raw[:344] + b"ni1\0" + raw[348:352], ".img"),
    ]


@pytest.fixture(scope="module")
def damaged(tmp_path_factory):
    d = tmp_path_factory.mktemp("damaged")
    for name, raw, _ in damaged_files():
        (d / name).write_bytes(raw)
    return d


@pytest.mark.parametrize("view,good", [("slabs", 7), ("voxels", 105)])
def test_damage_is_an_error_left_out_or_reported(spark, damaged, view, good):
    """No value is made up: a file that isn't whole gives no voxel, whatever part of it could be read."""
    whole = {name for name, _, error in damaged_files() if error is None}
    rows = nifti.read_volumes(spark, str(damaged), view, damaged="skip").groupBy("path").count().collect()
    assert {(r.path.rpartition("/")[2], r["count"]) for r in rows} == {(n, good) for n in whole}
    reported = nifti.read_volumes(spark, str(damaged), view, damaged="report", slabBytes="100")
    errors = {r.path.rpartition("/")[2]: r for r in reported.where("error IS NOT NULL").collect()}
    for name, _, said in damaged_files():
        assert said is None or said in errors[name].error and errors[name].z is None, (name, errors.get(name))
    assert len(errors) == len(damaged_files()) - 2 and reported.where("error IS NULL").count() == 2 * good
    assert reported.where("error IS NOT NULL").count() == len(errors)  # once, in how many parts it is read
    for name, _, said in damaged_files():
        one = nifti.read_volumes(spark, str(damaged / name), view)
        if said is None:
            assert one.count() == good
        else:
            with pytest.raises(Exception, match=name):
                one.collect()


def test_content_follows_the_same_rule(spark, damaged):
    files = spark.read.format("binaryFile").load(str(damaged))
    reported = nifti.decode_files(files, damaged="report").where("error IS NOT NULL").collect()
    # Bytes tell that a file isn't gzipped, and Spark doesn't list empty files.
    names = {name for name, _, error in damaged_files() if error} - {"plain.nii.gz", "empty.nii"}
    assert {r.path.rpartition("/")[2] for r in reported} == names
    assert nifti.decode_files(files, damaged="skip").count() == 3 * 7
    none = spark.createDataFrame([("a", b""), ("b", None)], "path string, content binary")
    assert {r.error is None for r in nifti.decode_files(none, damaged="report").collect()} == {False}
    with pytest.raises(Exception, match="Unreadable"):
        nifti.decode_files(files).collect()


def test_a_gzipped_file_is_read_no_further_than_asked(spark, damaged):
    """Its first slab is there, before what is damaged; whoever reads the last one learns of it."""
    rows = nifti.read_volumes(spark, str(damaged / "checksum.nii.gz"), z="0")
    assert [r.data[:2] for r in rows.collect()] == [[0.0, 1.0]]
    with pytest.raises(Exception, match="gzip"):
        nifti.read_volumes(spark, str(damaged / "checksum.nii.gz"), z="6").collect()


def test_missing_bytes_are_zero_if_asked_for(spark, damaged):
    last = nifti.read_volumes(spark, str(damaged / "cut.nii"), z="6", padShort="true").first().data
    assert last[-1] == 0 and last[-2] == (105 - 2) % 100
    with pytest.raises(Exception, match="gzip"):
        nifti.read_volumes(spark, str(damaged / "cut.nii.gz"), z="6", padShort="true").collect()


@pytest.mark.parametrize("zipped", [(False, False), (True, False), (False, True), (True, True)])
def test_pairs_of_header_and_image(spark, tmp_path, zipped):
    raw, values = volume(8, 2, ">", frames=2, magic=b"ni2\0\r\n\x1a\n", vox_offset=16)
    for kind, content, z in (("hdr", raw[:540], zipped[0]), ("img", bytes(16) + raw[544:], zipped[1])):
        (tmp_path / f"v.{kind}{'.gz' * z}").write_bytes(gzip.compress(content) if z else content)
    (tmp_path / "other.nii").write_bytes(volume(4)[0])
    for path in (tmp_path, tmp_path / f"v.hdr{'.gz' * zipped[0]}", tmp_path / f"v.img{'.gz' * zipped[1]}"):
        slabs = nifti.read_volumes(spark, str(path)).where("nz = 7 AND path LIKE '%v.%'").orderBy("t", "z").collect()
        assert [v for s in slabs for v in s.data] == values.tolist() and len(slabs) == 14
    # A plain file of voxels is read in parts by its own size, whatever its header's is.
    (pair,) = [f for f in nifti.volumes_listed(str(tmp_path), *nifti.PATTERNS) if ".hdr" in f[0]]
    assert pair[1] == (len(raw) - 528 if not zipped[1] else len((tmp_path / f"v.hdr{'.gz' * zipped[0]}").read_bytes()))
    assert nifti.volumes_listed(pair[0])[0] == pair
    reader = nifti.NiftiReader(None, {"path": pair[0], "slabbytes": "400", "view": "slabs"})
    assert (len(reader.partitions()) == 3) == (not zipped[1])
    assert sorted((z, t) for p in reader.partitions() for b in reader.read(p) for z, t in zip(b.column("z").to_pylist(), b.column("t").to_pylist())) == [(z, t) for z in range(7) for t in range(2)]
    headers = nifti.read_volumes(spark, str(tmp_path), "header").where("error IS NULL").collect()
    assert sorted((r.paired, r.vox_offset) for r in headers) == [(False, 352), (True, 16)]


def test_frames_of_a_fifth_dimension(spark, tmp_path):
    n = int(np.prod(SHAPE))
    values = np.arange(n * 6) % 1000
    (tmp_path / "v.nii").write_bytes(nifti_header.write_header((*SHAPE, 2, 3), 4) + values.astype("<i2").tobytes())
    slabs = nifti.read_volumes(spark, str(tmp_path)).orderBy("t", "z").collect()
    assert [s.t for s in slabs[::7]] == list(range(6)) and [v for s in slabs for v in s.data] == values.tolist()


def rows_to_write(spark, names, bad=None):
    rows = [(name, 3, 2, 4, 4, "<>"[k % 2], 2.0, float(k), 1.5, [float(k + i) for i in range(24 - (name == bad))]) for k, name in enumerate(names)]
    return spark.createDataFrame(rows, "name string, nx int, ny int, nz int, datatype int, order string, scl_slope double, scl_inter double, dz double, data array<double>")


def test_sink_of_whole_volumes(spark, tmp_path):
    nifti.register(spark)
    folder, names = str(tmp_path / "deep" / "out"), [f"v{k}.nii{'.gz' * (k % 3 == 0)}" for k in range(7)]
    rows_to_write(spark, names).repartition(3).write.format("nifti").mode("append").save(folder)
    back = nifti.as_volumes(nifti.read_volumes(spark, folder))
    got = {r.vol_id.rpartition("/")[2]: r.data for r in back.collect()}
    assert got == {name: [2.0 * (k + i) + k for i in range(24)] for k, name in enumerate(names)}
    assert {r.dz for r in nifti.read_volumes(spark, folder, "header").collect()} == {1.5}
    with pytest.raises(Exception, match="there already"):
        rows_to_write(spark, names[:1]).write.format("nifti").mode("append").save(folder)
    rows_to_write(spark, ["w.nii"]).write.format("nifti").mode("append").save(folder)
    assert len(nifti.listed(folder, "*")) == 8
    rows_to_write(spark, ["w.nii", "x.nii"]).write.format("nifti").mode("overwrite").save(folder)
    assert sorted(p.name for p in (tmp_path / "deep" / "out").iterdir()) == ["w.nii", "x.nii"]


def test_failed_and_repeated_writes_leave_no_file(spark, tmp_path):
    nifti.register(spark)
    folder = tmp_path / "out"
    for rows in (
        rows_to_write(spark, [f"v{k}.nii" for k in range(6)], bad="v4.nii").repartition(3),
        rows_to_write(spark, ["same.nii", "same.nii"]).repartition(2),
        rows_to_write(spark, ["../up.nii"]),
        rows_to_write(spark, ["v.txt"]),
        rows_to_write(spark, ["v.nii"]).withColumn("datatype", F.lit(128)),
        rows_to_write(spark, ["v.nii"]).withColumn("data", F.lit(None).cast("array<double>")),
        rows_to_write(spark, ["v.nii"]).drop("nz"),
    ):
        with pytest.raises(Exception):
            rows.write.format("nifti").mode("append").save(str(folder))
        assert not folder.exists() or not list(folder.iterdir())
    # A task that runs twice has drafts of its own each time; only those of the attempt that counts are named.
    from voxframe.sources.nifti_sink import NiftiWriter

    df = rows_to_write(spark, ["v.nii"])
    writer = NiftiWriter(df.schema, {"path": str(folder)}, False)
    batches = df.toArrow().to_batches()
    _, message = writer.write(iter(batches)), writer.write(iter(batches))
    writer.commit([message, None])
    assert [p.name for p in folder.iterdir()] == ["v.nii"]


def test_sink_of_slabs(spark, tmp_path):
    """A volume written slab by slab, of two frames, equals the one written whole; slabs out of order are refused."""
    nifti.register(spark)
    raw, values = volume(16, frames=2)
    rows = [("v.nii", 5, 3, 7, 2, t, z, values.reshape(2, 7, 15)[t, z].tolist()) for t in range(2) for z in range(7)]
    slabs = spark.createDataFrame(rows, "name string, nx int, ny int, nz int, nt int, t int, z int, data array<float>")
    slabs.repartition("name").sortWithinPartitions("name", "t", "z").write.format("nifti").mode("append").save(str(tmp_path / "a"))
    assert (tmp_path / "a" / "v.nii").read_bytes() == raw
    for bad in (slabs.coalesce(1).orderBy(F.desc("z")), slabs.where("z < 6"), slabs.where("t = 1")):
        with pytest.raises(Exception):
            bad.repartition(1).write.format("nifti").mode("append").save(str(tmp_path / "b"))
        assert not (tmp_path / "b").exists() or not list((tmp_path / "b").iterdir())


def test_catalog_opens_only_chosen_files(spark, folder, tmp_path):
    import shutil

    for name in ("a.nii", "b.nii.gz", "c.nii"):
        shutil.copy(folder / name, tmp_path / name)
    (tmp_path / "bad.nii").write_bytes(b"no")
    catalog = nifti.catalog(spark, str(tmp_path))
    catalog.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 4 and index.where("error IS NOT NULL").count() == 1
    # Files that the filter leaves out needn't be there any more.
    for name in ("a.nii", "b.nii.gz", "bad.nii"):
        (tmp_path / name).unlink()
    for slab_bytes in (100, 1 << 20):
        slabs = nifti.read_listed(index.where("nt = 2 AND datatype = 16"), slab_bytes=slab_bytes, z=(2, 4))
        assert sorted((r.t, r.z) for r in slabs.collect()) == [(0, 2), (0, 3), (1, 2), (1, 3)]
    assert nifti.read_listed(index.where("nx > 5")).count() == 0


def test_table_function(spark, damaged):
    from voxframe.sources import nifti_udtf

    nifti_udtf.register(spark)
    files = spark.read.format("binaryFile").load(str(damaged))
    rows = spark.sql("SELECT * FROM nifti_voxels(TABLE(SELECT path, content FROM {f}))", f=files)
    assert rows.where("error IS NULL").count() == 3 * 105 and rows.where("error IS NOT NULL").count() == len(damaged_files()) - 4
    assert rows.where("path LIKE '%good.nii' AND x = 4 AND y = 1 AND z = 2").first().v == 39.0


def test_stream_takes_each_file_once(spark, tmp_path):
    """Files that arrive between batches and over a restart; a stream that begins anew takes all of them."""
    import os

    nifti.register(spark)
    source, marks = tmp_path / "in", str(tmp_path / "marks")
    source.mkdir()

    def arrive(name, at):
        (source / f"_{name}").write_bytes(volume(4)[0])
        os.utime(source / f"_{name}", ns=(at, at))
        (source / f"_{name}").rename(source / name)

    def run(view="slabs"):
        stream = spark.readStream.format("nifti").option("view", view).option("slabBytes", "60").load(str(source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", marks).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        names = spark.read.schema("path string, z int").parquet(str(tmp_path / "out")).groupBy("path").count().collect()
        return {r.path.rpartition("/")[2]: r["count"] for r in names}

    arrive("a.nii", 10**18)
    arrive("b.nii", 10**18)
    assert run() == {"a.nii": 7, "b.nii": 7}
    assert run() == {"a.nii": 7, "b.nii": 7}
    arrive("c.nii", 10**18 + 1)
    arrive("bb.nii", 10**18 + 1)
    assert run() == {"a.nii": 7, "b.nii": 7, "bb.nii": 7, "c.nii": 7}


def test_header_json_is_read_back(spark, folder):
    headers = nifti.read_volumes(spark, str(folder), "header", pathGlobFilter="*")
    back = {r.path: r for r in nifti_header.parsed_json(nifti_header.header_json(headers)).collect()}
    for r in headers.collect():
        got = back[r.path]
        assert (got.error is None) == (r.error is None)
        assert r.error or all(got[c] == r[c] for c in nifti_header.FIELDS)
    odd = spark.createDataFrame([("p", "no json"), ("q", None)], "path string, json string")
    assert all(r.error for r in nifti_header.parsed_json(odd).collect())


def test_decoded_volumes_are_kept_as_a_table(spark, folder, tmp_path):
    from voxframe.sources import decoded

    place = str(tmp_path / "decoded")
    catalog = nifti.catalog(spark, str(folder))
    table = decoded.keep(nifti.read_listed(catalog.where("nt = 1")), place)
    left = decoded.missing(catalog, table)
    assert [r.path.rpartition("/")[2] for r in left.collect()] == ["c.nii"]
    table = decoded.keep(nifti.read_listed(left), place, "append")
    assert sorted(map(str, table.collect())) == sorted(map(str, nifti.read_volumes(spark, str(folder)).collect()))
    one = table.where("z = 3 AND t = 1")
    assert one.count() == 1 and "EqualTo(z,3)" in one._jdf.queryExecution().executedPlan().toString()
    assert decoded.missing(catalog, table).count() == 0 and decoded.without(table, one.first().path).count() == 14
    with pytest.raises(Exception, match="already exists"):
        decoded.keep(nifti.read_listed(catalog), place)
