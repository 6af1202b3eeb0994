import hashlib
import math
import random
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxframe.llm import media_ogg, mixing, queries, warc_fixity


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"OggS", bytes(range(256))):
        assert media_ogg.ogg_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [64, 4096, 4160, 255 * 64, 8192, 12288, 100_032])
@pytest.mark.parametrize("segments", [1, 3, 255])
@pytest.mark.parametrize("streams", [1, 2, 3])
def test_ogg_round_trip_and_damage(size, segments, streams):
    rng = random.Random(size + segments)
    payload = rng.randbytes(size)
    media = media_ogg.encode(payload, streams=streams, segments=segments)
    back, packets, rate = media_ogg.decode(media)
    assert back == payload and rate == media_ogg.SAMPLE_RATE
    assert [t for t, _, _ in packets] == list(range(0, size, media_ogg.PACKET_BYTES))
    for _ in range(5):
        bad = bytearray(media)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        with pytest.raises(media_ogg.Damaged):
            media_ogg.decode(bytes(bad))
    with pytest.raises(media_ogg.Damaged):
        media_ogg.decode(media[:-10])


def slow_ogg(payload):
    """The file of a payload by the format's rules alone: two streams of 4096-byte packets in turn, 255 segments to a page."""
    packets = {0: [], 1: []}
    for k in range(0, len(payload), 4096):
        packets[k // 4096 % 2].append((payload[k : k + 4096], min(k + 4096, len(payload))))
    pages = {0: [], 1: []}
    for s in (0, 1):
        head = b"PCM8" + bytes(4) + bytes([1, s]) + (2).to_bytes(2, "little") + (8000).to_bytes(4, "little") + (4096).to_bytes(4, "little")
        # Segments: (bytes, ends a packet, granule there); the header packet has a page of its own.
        segments = []
        for packet, granule in packets[s]:
            cut = [packet[k : k + 255] for k in range(0, len(packet) + 1, 255)]
            segments += [(c, k == len(cut) - 1, granule) for k, c in enumerate(cut)]
        groups = [[(head, True, 0)], *[segments[k : k + 255] for k in range(0, len(segments), 255)]]
        open_ = False
        for n, group in enumerate(groups):
            ends = [g for _, end, g in group if end]
            flags = open_ + 2 * (n == 0) + 4 * (n == len(groups) - 1)
            granule = ends[-1] if ends else -1
            before = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + (s + 1).to_bytes(4, "little") + n.to_bytes(4, "little")
            after = bytes([len(group)]) + bytes(len(c) for c, _, _ in group) + b"".join(c for c, _, _ in group)
            pages[s].append(before + slow_checksum(before + bytes(4) + after).to_bytes(4, "little") + after)
            open_ = not group[-1][1]
    first = pages[0][0] + pages[1][0]
    turns = range(1, max(map(len, pages.values())))
    return first + b"".join(pages[s][k] for k in turns for s in (0, 1) if k < len(pages[s]))


def slow_feature(payload):
    count = -(-len(payload) // 4096)
    steps = sum(abs(a - b) for a, b in zip(payload, payload[1:]))
    return f"streams={min(2, count)};packets={count};ms={len(payload) * 1000 // 8000};last_ms={(count - 1) * 4096 * 1000 // 8000};sum={sum(payload)};steps={steps};silent={payload.count(0)}"


def test_media_bytes_and_features_by_hand(spark, sf_dir, texts):
    want = {}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = slow_ogg(payload)
        want[i] = (len(media), hashlib.sha256(media).hexdigest(), slow_feature(payload))
    got = {r.doc_id: (r.media_bytes, r.media_sha256, r.feature) for r in queries.QUERIES["op10_ogg_media"](spark, sf_dir).collect()}
    assert got == want


def check_media(rows, got):
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((-1 if i is None else i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:5]) for r in got) == sorted(want)
    assert all(r.media_bytes > r.payload_bytes and r.feature for r in got)


def test_media(spark, sf_dir, texts, edge, edge_rows, empty):
    check_media(texts, queries.QUERIES["op10_ogg_media"](spark, sf_dir).collect())
    check_media([r[:2] for r in edge_rows], media_ogg.read_media(media_ogg.to_media(edge)).collect())
    assert media_ogg.read_media(media_ogg.to_media(empty)).count() == 0


def test_damaged_media_rows_say_so(spark):
    media = spark.createDataFrame([(1, 5, b"no"), (2, 5, None), (3, 5, media_ogg.encode(bytes(64)))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: (r.payload_bytes, r.error) for r in media_ogg.read_media(media).collect()}
    assert got[3] == (64, None) and all(got[k][0] is None and got[k][1] for k in (1, 2))


def edf(stock):
    """Earliest deadline first, slot by slot, by hand: the list of (source, block). Of equal deadlines sources of one block a cycle come last."""
    out, cycle = [], 0
    while any(n > cycle * w for n, w in stock.values()):
        m = {s: min(w, n - cycle * w) for s, (n, w) in stock.items() if n > cycle * w}
        total, done = sum(m.values()), dict.fromkeys(m, 0)
        for slot in range(total):
            ready = [(-(-(done[s] + 1) * total // m[s]), m[s] == 1, s) for s in sorted(m) if done[s] < m[s] and done[s] * total // m[s] <= slot]
            s = min(ready)[2]
            out.append((s, cycle * stock[s][1] + done[s]))
            done[s] += 1
        cycle += 1
    return out


def scheduled(spark, stock):
    """The list of (source, block) that the schedule of (source -> blocks, weight) stands for."""
    rows = spark.createDataFrame([(s, n, w) for s, (n, w) in stock.items()], "source string, blocks long, weight int")
    runs, slots = mixing.schedule(rows)
    place, own = {}, {r.run: r for r in runs.collect()}
    for r in slots.collect():
        run = own[r.run]
        for cycle in range(run.from_cycle, run.to_cycle):
            at = run.base + (cycle - run.from_cycle) * run.slots + r.slot
            assert at not in place
            place[at] = (r.source, cycle * stock[r.source][1] + r.i)
    return [place[k] for k in range(len(place))]


@pytest.mark.parametrize("seed", range(6))
def test_schedule_against_slot_by_slot(spark, seed):
    rng = random.Random(seed)
    stock = {f"s{k}": (rng.randint(1, 60), rng.randint(1, 9)) for k in range(rng.randint(1, 7))}
    stock |= {f"tail{k}": (rng.randint(1, 5), 1) for k in range(seed * 3)}
    assert scheduled(spark, stock) == edf(stock)


def test_schedule_of_a_thousand_sources(spark):
    """A source for each host: sources of one block a cycle in the main, all running short at different cycles."""
    rng = random.Random(3)
    stock = {f"host{k:04}": (rng.randint(1, 200 if k < 30 else 40), rng.randint(2, 9) if k < 30 else 1) for k in range(1000)}
    began = time.monotonic()
    got = scheduled(spark, stock)
    assert time.monotonic() - began < 30
    assert got == edf(stock)


def test_shares_stay_within_one_block(spark):
    stock = {"a": (500, 50), "b": (300, 30), "c": (130, 13), "d": (70, 7)}
    total, done = 100, dict.fromkeys(stock, 0)
    for t, (s, _) in enumerate(edf(stock), 1):
        done[s] += 1
        assert all(abs(done[x] - t * w / total) < 1 for x, (_, w) in stock.items())


def test_mixing_query_equals_sql(spark, sf_dir, duck, same_rows):
    same_rows(queries.QUERIES["op7_source_mixing"](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL["op7_source_mixing"]).df())


def test_order_survives_files(spark, documents, tmp_path):
    """Many files of many sizes: what is read back in file order is the mixture slot by slot."""
    docs = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 10**6))
    ordered = mixing.in_mixed_order(docs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered.write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "mixed"))
    assert back.columns == documents.columns and len(back.inputFiles()) > 2
    file, row = mixing.file_order(back)
    got = [r.doc_id for r in back.select("doc_id", file.alias("f"), row.alias("r")).orderBy("f", "r").collect()]
    want = [r.doc_id for r in mixing.mix(docs, columns=["doc_id"]).orderBy("mix_block", "source", "at").select("row.doc_id").collect()]
    assert got == want


def test_mixing_query(spark, sf_dir, documents):
    rows = queries.QUERIES["op7_source_mixing"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    size = {r.doc_id: max(1, len((r.text or "").encode())) for r in documents.collect()}
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.source, r.at)):
        assert r.at == at[r.source] and r.source_block == r.at // mixing.BLOCK_BYTES
        at[r.source] += size[r.doc_id]
    total = sum(n**0.5 for n in at.values())
    # Halves round away from zero, as in SQL.
    stock = {s: (-(-n // mixing.BLOCK_BYTES), max(1, math.floor(n**0.5 / total * mixing.CYCLE + 0.5))) for s, n in at.items()}
    order = {b: k for k, b in enumerate(edf(stock))}
    assert all(r.mix_block == order[r.source, r.source_block] for r in rows)


def test_mixing_of_edge_rows(spark, edge, empty):
    weights = spark.createDataFrame([("s0", 3), ("s1", 1), (None, 2), ("s9", 5)], "source string, weight int")
    rows = mixing.mix(edge, weights, block_bytes=500).collect()
    assert len(rows) == edge.count() and {r.source for r in rows} == {"", "s0", "s1", "s2"}
    assert mixing.in_mixed_order(edge).columns == edge.columns
    assert mixing.in_mixed_order(edge).count() == edge.count()
    assert mixing.mix(empty).count() == 0


def test_mixing_plan_has_no_python(spark, documents):
    plan = mixing.mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_fixity_query(spark, sf_dir, duck, same_rows):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    sql = queries.ORACLE_SQL["op1_warc_fixity"].replace("FROM pages)", f"FROM '{folder}/pages.parquet')")
    same_rows(queries.QUERIES["op1_warc_fixity"](spark, folder).toPandas(), duck.sql(sql).df())


def test_fixity_query_damages_every_file(spark, tmp_path):
    """Three of every 50 pages, in all ranges of all files, and each is found."""
    pages = spark.range(1100).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("html"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = defaultdict(int)
    for r in queries.QUERIES["op1_warc_fixity"](spark, str(tmp_path)).collect():
        got[r.file, r.status] += 1
    whole = warc_fixity.FILE_PAGES // 50
    assert got == {(f, s): n * (whole if f < 4 else 2) for f in range(5) for s, n in (("changed", 2), ("missing", 1))}


RECORDS = "file long, record_id string, offset long, length long, hash string"


def test_fixity_finds_each_kind_of_damage(spark):
    rows = [(f, f"r{o}", o, 10, f"{f}-{o}") for f in range(3) for o in range(0, 40 * 65536, 30_000)]
    ours = spark.createDataFrame(rows, RECORDS)
    assert warc_fixity.audit(ours, ours).count() == 0
    theirs = [r for r in rows if (r[0], r[2]) != (1, 60_000) and r[0] != 2]
    theirs = [(*r[:4], "bad") if (r[0], r[2]) == (0, 30_000 * 40) else r for r in theirs] + [(0, "new", 7, 3, "more"), (9, "r", 0, 3, "file")]
    got = {(r.file, r.offset, r.status) for r in warc_fixity.audit(ours, spark.createDataFrame(theirs, ours.schema)).collect()}
    lost = {(2, r[2], "missing") for r in rows if r[0] == 2}
    assert got == lost | {(1, 60_000, "missing"), (0, 30_000 * 40, "changed"), (0, 7, "extra"), (9, 0, "extra")}


def laid_out(rows):
    """Records (file, record_id, length, hash) one after the other."""
    out, at = [], defaultdict(int)
    for file, name, n, h in rows:
        out.append((file, name, at[file], n, h))
        at[file] += n
    return out


def test_lost_and_longer_records_are_found_alone(spark):
    """Each replica has its own offsets: all later records have moved, and only what changed is reported, repeated and null names too."""
    rows = [(1, f"r{k}" if k % 7 else "twice" if k % 2 else None, 40_000 + k, f"h{k}") for k in range(60)] + [(2, f"r{k}", 9, f"x{k}") for k in range(5)]
    ours = spark.createDataFrame(laid_out(rows), RECORDS)
    changed = [(f, n, size + 500, "other") if h == "h11" else (f, n, size, h) for f, n, size, h in rows if h != "h5"]
    changed[30:30] = [(1, "new", 77, "new")]
    theirs = laid_out(changed)
    got = sorted((r.file, r.offset, r.length, r.status, r.hash, r.other_hash) for r in warc_fixity.audit(ours, spark.createDataFrame(theirs, RECORDS)).collect() if r.status != "extra")
    place = {r[4]: r for r in laid_out(rows)}
    assert got == [(1, place["h5"][2], place["h5"][3], "missing", "h5", None), (1, place["h11"][2], place["h11"][3], "changed", "h11", "other")]
    extra = [(r.file, r.offset, r.other_hash) for r in warc_fixity.audit(ours, spark.createDataFrame(theirs, RECORDS)).where("status = 'extra'").collect()]
    assert extra == [(1, next(r[2] for r in theirs if r[4] == "new"), "new")]


def test_descent_reads_few_records(spark):
    """Of 20,000 records in 4 files three are damaged, one of them lost at the beginning: a few leaves are read, and no file that is whole."""
    rows = [(k % 4, f"r{k}", 1000 + k % 37, f"h{k}") for k in range(20_000)]
    ours = spark.createDataFrame(laid_out(rows), RECORDS)
    changed = [(f, n, size, "bad" if h in ("h4001", "h18001") else h) for f, n, size, h in rows if h != "h1"]
    theirs = spark.createDataFrame(laid_out(changed), RECORDS)
    left, right = (side.collect() for side in warc_fixity.differing_records(ours, theirs))
    assert {r.file for r in left} == {1} and {"h1", "h4001", "h18001"} <= {r.hash for r in left}
    assert max(len(left), len(right)) < 3 * 2 * warc_fixity.LEAF_RECORDS
    found = sorted((r.hash, r.status) for r in warc_fixity.audit(ours, theirs).collect())
    assert found == [("h1", "missing"), ("h18001", "changed"), ("h4001", "changed")]
    assert all(x.count() == 0 for x in warc_fixity.differing_records(ours, ours))


def test_alike_records_make_leaves_of_bounded_size(spark):
    """Records that are all alike have no border among them, or each is one; lost ones are still counted."""
    for h in ("same", "other", "third", "x", "y"):
        rows = laid_out([(1, f"r{k}", 10, h) for k in range(1000)] + [(1, "end", 5, "end")])
        ours = spark.createDataFrame(rows, RECORDS)
        leaves = warc_fixity.merkle_leaves(ours)
        assert leaves.where(f"end - start > 10 * {warc_fixity.LEAF_RECORDS}").count() == 0
        assert leaves.orderBy("start").first().start == 0 and leaves.agg(F.max("end")).first()[0] == 10_005
        theirs = spark.createDataFrame(laid_out([(f, n, size, x) for f, n, _, size, x in rows if n not in ("r3", "r700")]), RECORDS)
        found = warc_fixity.audit(ours, theirs).collect()
        assert {r.status for r in found} == {"missing"} and len(found) == 2


def test_warc_files_are_parsed(spark, tmp_path):
    """Records written to files, plain and gzipped member by member, come back with their offsets; a cut file says so."""
    import gzip

    pages = spark.createDataFrame([(k, f"http://a/{k}", "ü" * k + "\r\n\r\nWARC/1.0\r\n") for k in range(6)], "page_id long, url string, html string")
    records = [r.record.encode() for r in warc_fixity.page_records(pages).orderBy("page_id").collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc").write_bytes(b"".join(records)[:-3])
    (tmp_path / "d.warc").write_bytes(b"")
    got = defaultdict(list)
    for r in warc_fixity.read_warc(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("file", "offset").collect():
        got[r.file[-len("x.warc") :] if r.file.endswith("c") else "gz"].append((r.record_id, r.offset, r.length, r.hash, r.error))
    want, at = [], 0
    for k, r in enumerate(records):
        want.append((f"<urn:page:{k}>", at, len(r), hashlib.sha256(r).hexdigest(), None))
        at += len(r)
    assert got["a.warc"] == got["gz"] == want and got["c.warc"][:-1] == want[:-1]
    assert got["c.warc"][-1][0] is None and got["c.warc"][-1][4] and "d.warc" not in got


def test_records_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a/é", "ü", "x"), (2, "http://a/é", "ü", "x"), (None, "u", "h", "x"), (None, "v", None, "x"), (3, "", "a" * 100_000, "x")], "page_id long, url string, html string, record string")
    records = warc_fixity.page_records(pages)
    assert records.count() == 6 and records.where("file < 0").select("file").distinct().count() == 2
    hashes = warc_fixity.record_hashes(records)
    spans = sorted((r.file, r.offset, r.offset + r.length) for r in hashes.collect())
    assert all(a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(spans, spans[1:]))
    assert sum(b - a for _, a, b in spans) == sum(len(r.record.encode()) for r in records.collect())
    assert warc_fixity.audit(hashes, hashes).count() == 0
    none = warc_fixity.record_hashes(warc_fixity.page_records(pages.where(F.lit(False))))
    assert warc_fixity.audit(none, none).count() == 0
    assert warc_fixity.audit(hashes, none).where("status <> 'missing'").count() == 0


def test_ties_are_placed_alike_however_rows_are_dealt(spark):
    """Rows of one doc_id, with texts of different sizes, and rows that differ in another column alone."""
    rows = [(7, "x" * n, "s", k) for k, n in enumerate((100, 9000, 1, 5000, 5000))] + [(k, "y" * 300, "s", 0) for k in range(30)]
    places = []
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, n int").repartition(len(places) + 1)
        places.append(sorted(tuple(r) for r in mixing.mix(docs).select("row.doc_id", "row.n", F.length("row.text").alias("l"), "mix_block", "at").collect()))
    assert places[0] == places[1] == places[2] and len(set(places[0])) == len(rows)


def gz_record(k):
    import gzip

    body = f"page {k} " * (k + 1)
    return gzip.compress(f"WARC/1.0\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode())


def test_damaged_gzip_members_are_reported(spark):
    members = [gz_record(k) for k in range(5)]
    flipped = bytearray(members[1])
    flipped[-6] ^= 1  # in the checksum
    files = [
        ("whole", b"".join(members), [(f"<urn:{k}>", None) for k in range(5)]),
        ("flipped", members[0] + bytes(flipped) + b"".join(members[2:]), [("<urn:0>", None), (None, "gzip")] + [(f"<urn:{k}>", None) for k in (2, 3, 4)]),
        ("cut", b"".join(members)[:-3], [(f"<urn:{k}>", None) for k in range(4)] + [(None, "gzip")]),
        ("junk", members[0] + b"no gzip at all" + members[3], [("<urn:0>", None), (None, "gzip"), ("<urn:3>", None)]),
        ("nothing whole", members[0][:20], [(None, "gzip")]),
        ("tail", members[2] + bytes(9), [("<urn:2>", None), (None, "gzip")]),
    ]
    rows = warc_fixity.read_warc(spark.createDataFrame([(f, bytes(c)) for f, c, _ in files], "path string, content binary")).collect()
    for name, _, want in files:
        got = sorted((r.offset, r.length == 0, r.record_id, r.error) for r in rows if r.file == name)
        assert [(i, e and "gzip") for _, _, i, e in sorted(got, key=lambda g: (g[0], not g[1]))] == want


def test_headers_of_a_stream_that_contradict_are_damage(spark):
    def with_header(**fields):
        values = {"magic": media_ogg.MAGIC, "version": 1, "stream": 0, "streams": 1, "rate": 8000, "step": 4096} | fields
        return b"".join(media_ogg._pages(0, [(media_ogg.CODEC.pack(*values.values()), 0), (b"x" * 64, 64)], 255))

    assert media_ogg.decode(with_header())[0] == b"x" * 64
    bad = [with_header(**f) for f in ({"rate": 0}, {"step": 0}, {"streams": 0}, {"streams": 2}, {"stream": 1}, {"version": 2}, {"magic": b"other  "})]
    for media in bad:
        with pytest.raises(media_ogg.Damaged):
            media_ogg.decode(media)
    rows = media_ogg.read_media(spark.createDataFrame([(k, 64, m) for k, m in enumerate(bad)], "doc_id long, n_bytes long, media binary")).collect()
    assert len(rows) == len(bad) and all(r.error and r.payload_bytes is None for r in rows)
    one, other = (media_ogg._pages(s, [(media_ogg.CODEC.pack(media_ogg.MAGIC, 1, s, 2, rate, 4096), 0), (b"x", 1)], 255) for s, rate in ((0, 8000), (1, 4000)))
    with pytest.raises(media_ogg.Damaged, match="contradict"):
        media_ogg.decode(b"".join([one[0], other[0], *one[1:], *other[1:]]))
