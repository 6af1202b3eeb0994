"""Fixity audit of WARC replicas by Merkle trees.

Each record is hashed, and ordered ranges of offsets are hashed into trees. A leaf covers a range of some records of one WARC file, a node
a range of some nodes of the level below, and its hash is that of its parts' hashes in order. Borders lie where records' own hashes
say so, a border of a level being one of all levels below. So a record that was lost, changed or put in moves all later ones, but changes
the one leaf that holds it, and the nodes above that: all other ranges have the same hashes in both replicas, wherever they stand.

Roots are compared first: files whose roots agree are whole and not looked at again. Then the trees are compared from the top down: of the
children of nodes that the other replica lacks those are left that it lacks too, and only records of leaves that are left at the end are
compared, by name. Damage to few records costs a few leaves for each, however long the file is.

All nodes of a level are one DataFrame, built from the level below by one grouping.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import checkpointed, prepare, table, text_or_empty

#: One record in 2**FANOUT_BITS ends a leaf, one in that number of leaves' ends a node of the next level, and so on; levels between leaves and root.
FANOUT_BITS, LEVELS = 3, 2
#: Records of a leaf at the most; more alike ones, which have no border among them, are several.
LEAF_RECORDS = 64
#: Pages of one WARC file in :func:`page_records`.
FILE_PAGES = 250


def warc_record(url: Column, name: Column, payload: Column) -> Column:
    """The bytes of a resource record of this URL and payload."""
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"), name,
        F.lit(">\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def page_records(pages: DataFrame) -> DataFrame:
    """Records (file, record_id, page_id, record) of ``pages(page_id, url, html)``, FILE_PAGES consecutive page_ids to a WARC file.

    Null url and html are empty. Pages with a null page_id are dealt to files below zero by a hash of what they
    hold, so these grow no larger than the others; their record_id is that hash.
    """
    own = F.xxhash64(F.coalesce("url", F.lit("")), text_or_empty("html"))
    return pages.select(
        F.coalesce(F.expr(f"page_id div {FILE_PAGES}"), -1 - F.shiftrightunsigned(own, 40)).alias("file"),
        F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("h"), F.hex(own))).alias("record_id"),
        "page_id",
        warc_record(F.coalesce("url", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit("")), text_or_empty("html")).alias("record"),
    )


_HEAD = re.compile(rb"WARC/1\.\d\r\n(.*?)\r\n\r\n", re.S)


def _split(raw: bytes) -> Iterator[tuple[str | None, int, int, bytes, str | None]]:
    """(record_id, offset, length, bytes, error) of each record of a WARC file; what is no record up to the file's end is one with an error."""
    at = 0
    while at < len(raw):
        head = _HEAD.match(raw, at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head[1].split(b"\r\n"))} if head else {}
        size = fields.get(b"content-length", b"")
        end = head.end() + int(size) + 4 if head and size.isdigit() else len(raw) + 1
        if end > len(raw) or raw[end - 4 : end] != b"\r\n\r\n":
            yield None, at, len(raw) - at, raw[at:], "not a whole record"
            return
        yield fields.get(b"warc-record-id", b"").decode("utf-8", "replace"), at, end - at, raw[at:end], None
        at = end


#: What a gzip member begins with: two fixed bytes and the method, deflate.
_GZIP = b"\x1f\x8b\x08"
#: Bytes of a member that are inflated at a time.
_INFLATED = 1 << 16


def _member(raw: memoryview, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a place and where it ends; none if it isn't whole or its checksum is wrong."""
    one, out = zlib.decompressobj(31), []
    try:
        while at < len(raw) and not one.eof:
            out.append(one.decompress(raw[at : at + _INFLATED]))
            at = min(len(raw), at + _INFLATED) - len(one.unused_data)
    except zlib.error:
        return None
    return (b"".join(out), at) if one.eof else None


def _members(raw: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Stretches of the content of a gzipped file, (bytes, no error) of members that follow each other and are whole, (nothing, error) of
    what lies between: from a damaged member on to the next place where a whole one begins."""
    at, good, view = 0, [], memoryview(raw)
    while at < len(raw):
        found = _member(view, at)
        if found:
            good.append(found[0])
            at = found[1]
            continue
        if good:
            yield b"".join(good), None
        good, begin = [], at
        while at >= 0 and not _member(view, at):
            at = raw.find(_GZIP, at + 1)
        at = len(raw) if at < 0 else at
        yield b"", f"damaged gzip member in bytes {begin} to {at} of the file"
    if good:
        yield b"".join(good), None


def read_warc(files: DataFrame) -> DataFrame:
    """(file, record_id, offset, length, hash, error) of the records in files(path, content), as ``binaryFile`` reads them.

    ``file`` is the path. Gzipped files are inflated member by member, and offsets are those of the content. A damaged
    member gives a row with an error, its record_id null and its length zero; reading goes on at the next whole member, whose offset
    is that of the content that could be read. Null content has no record; what can't be read as a record gives a row with an error too.
    """
    prepare(files.sparkSession)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at, path in enumerate(rows.column(0).to_pylist()):
                raw = rows.column(1)[at].as_py() or b""
                out, before = [], 0
                for part, error in _members(raw) if raw[:2] == _GZIP[:2] else [(raw, None)]:
                    if error:
                        out.append((path, None, before, 0, hashlib.sha256(part).hexdigest(), error))
                    out += [(path, i, before + o, n, hashlib.sha256(r).hexdigest(), e) for i, o, n, r, e in _split(part)]
                    before += len(part)
                if out:
                    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["file", "record_id", "offset", "length", "hash", "error"])

    return files.select("path", "content").mapInArrow(parsed, "file string, record_id string, offset long, length long, hash string, error string")


def record_digest(record: Column) -> Column:
    """(length, hash) of a record; null of a null one."""
    return F.when(record.isNotNull(), F.struct(F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("hash")))


def with_offsets(records: DataFrame, *order: str) -> DataFrame:
    """Adds ``offset`` to records(file, size, ...): where each stands in its file, in the given order.

    A file is as long as its records, so ``file`` must not be a key that grows with the corpus. Only what the
    rows hold is shuffled, so records are best replaced by their digests before.
    """
    upto = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("offset", F.sum("size").over(upto) - F.col("size"))


def record_hashes(records: DataFrame) -> DataFrame:
    """(file, record_id, offset, length, hash) of records(file, record_id, page_id, record), which follow each other by page_id; a null record is empty."""
    digest = record_digest(F.coalesce("record", F.lit("")))
    small = records.select("file", "record_id", "page_id", digest.alias("d")).withColumn("size", F.col("d.length"))
    return with_offsets(small, "page_id", "d").select("file", "record_id", "offset", "d.length", "d.hash")


#: What names a leaf within its file: the number of its node on each level from the top on, its own, and its part where records are alike.
PLACE = [*(f"l{k}" for k in range(LEVELS, -1, -1)), "part"]


def placed_records(records: DataFrame) -> DataFrame:
    """Adds PLACE to records(file, record_id, offset, length, hash): the leaf that each is in. A file's records are sorted by one task, digests only."""
    line = Window.partitionBy("file").orderBy("offset", "hash").rowsBetween(Window.unboundedPreceding, -1)
    own = F.xxhash64("length", "hash")
    ends = {f"l{k}": F.coalesce(F.sum((F.pmod(own, F.lit(1 << FANOUT_BITS * (k + 1))) == 0).cast("int")).over(line), F.lit(0)) for k in range(LEVELS + 1)}
    inner = Window.partitionBy("file", "l0").orderBy("offset", "hash")
    return records.withColumns(ends).withColumn("part", F.floor((F.row_number().over(inner) - 1) / LEAF_RECORDS).cast("int"))


def _hash_of(order: list[str], parts: list[str]) -> Column:
    """The hash of a group's parts in their order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *parts)))
    text = F.transform(rows, lambda p: F.concat_ws(":", *[p[c].cast("string") for c in parts]))
    return F.sha2(F.array_join(text, "\n").cast("binary"), 256).alias("hash")


def merkle_leaves(records: DataFrame) -> DataFrame:
    """(file, PLACE, start, end, hash): the ranges of offsets that leaves cover, and the hashes of their records in order."""
    span = F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end")
    return placed_records(records).groupBy("file", *PLACE).agg(*span, _hash_of(["offset"], ["length", "hash"]))


def merkle_level(leaves: DataFrame, level: int) -> DataFrame:
    """(file, the place's first columns, hash) of the nodes of a level above the leaves, LEVELS at the top; one more gives the root of each file."""
    nodes, place = leaves.select("file", *PLACE, "hash"), list(PLACE)
    for k in range(level):
        # The first step puts leaves, with their parts, into nodes of the first level.
        inside, place = (place[-2:], place[:-2]) if k == 0 else (place[-1:], place[:-1])
        nodes = nodes.groupBy("file", *place).agg(_hash_of(inside, ["hash"]))
    return nodes


def _lacking(ours: DataFrame, theirs: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of nodes (file, place, hash) of both replicas those that the other lacks; of equal ones of a file as many as it has fewer."""
    nth = F.row_number().over(Window.partitionBy("file", "hash").orderBy(*place))
    a, b = (side.select("file", *place, "hash", nth.alias("nth")) for side in (ours, theirs))
    key = ["file", "hash", "nth"]
    left, right = ((one.join(other.select(*key), key, "left_anti").select("file", *place)) for one, other in ((a, b), (b, a)))
    return checkpointed(left), checkpointed(right)


def differing_records(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of the leaves in which the replicas differ, of each; what is found by descending from differing roots alone."""
    sides = (ours, theirs)
    leaves = [checkpointed(merkle_leaves(side)) for side in sides]
    roots = [merkle_level(side, LEVELS + 1).withColumnRenamed("hash", name) for side, name in zip(leaves, "ab")]
    files = checkpointed(roots[0].join(roots[1], "file", "full_outer").where("NOT (a <=> b)").select("file"))
    left = [files, files]
    for level in range(LEVELS, -1, -1):
        place = PLACE if not level else PLACE[: LEVELS - level + 1]
        above = ["file", *PLACE[: LEVELS - level]]
        nodes = [merkle_level(side.join(up, above, "left_semi"), level) for side, up in zip(leaves, left)]
        left = list(_lacking(*nodes, place))
    found = [placed_records(side.join(files, "file", "left_semi")).join(up, ["file", *PLACE], "left_semi").drop(*PLACE) for side, up in zip(sides, left)]
    return found[0], found[1]


def _numbered(records: DataFrame) -> DataFrame:
    """Adds ``nth``, which tells records of one name apart by their order; a null name is a name."""
    same = Window.partitionBy("file", "record_id").orderBy("offset", "hash")
    return records.withColumn("record_id", F.coalesce("record_id", F.lit(""))).withColumn("nth", F.row_number().over(same))


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Where the replica ``theirs`` departs from ``ours``; both are (file, record_id, offset, length, hash) of records.

    Returns file, offset, length, status ('changed', 'missing' in theirs, 'extra' in theirs), hash and
    other_hash. Offsets are those of the replica's own index, in ``ours`` but for extra records; a record that
    only moved isn't reported. Equal replicas, empty ones too, give no row. A file or branch that only one
    replica has differs as a whole. Repeated names are matched in their order within the leaves that differ. Both tables are read twice,
    so what is costly to compute should be checkpointed before.
    """
    left, right = map(_numbered, differing_records(ours, theirs))
    right = right.select("file", "record_id", "nth", F.col("offset").alias("other_offset"), F.col("length").alias("other_length"), F.col("hash").alias("other_hash"))
    both = left.join(right, ["file", "record_id", "nth"], "full_outer").where("NOT (hash <=> other_hash)")
    status = F.when(F.col("other_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    return both.select("file", F.coalesce("offset", "other_offset").alias("offset"), F.coalesce("length", "other_length").alias("length"), status.alias("status"), "hash", "other_hash")


def damaged(record: Column, page_id: Column) -> Column:
    """A replica's record with known damage, as none is at hand: of every 50 page_ids, 7 has its last payload
    character replaced, 23 is missing and 31 has the first byte of its header changed; all others are whole."""
    kind = page_id % 50
    changed = F.when(kind == 7, F.concat(F.substring(record, F.lit(1), F.length(record) - 5), F.lit("~\r\n\r\n")))
    changed = changed.when(kind == 31, F.concat(F.lit("w"), F.substr(record, F.lit(2)))).when(kind == 23, F.lit(None))
    return changed.otherwise(record)


def op1(spark, sf_dir: str) -> DataFrame:
    """All pages as records of WARC files, held against a damaged replica, in which records are missing and all later ones have moved."""
    records = page_records(table(spark, sf_dir, "pages"))
    record, page_id = F.col("record"), F.col("page_id")
    # Digests alone are shuffled, not records.
    both = checkpointed(records.select("file", "record_id", "page_id", record_digest(record).alias("ours"), record_digest(damaged(record, page_id)).alias("theirs")))
    sides = []
    for side in ("ours", "theirs"):
        there = both.where(F.col(side).isNotNull()).select("file", "record_id", "page_id", F.col(side).alias("d")).withColumn("size", F.col("d.length"))
        sides.append(with_offsets(there, "page_id", "d").select("file", "record_id", "offset", "d.length", "d.hash"))
    return audit(*sides)


OP1_SQL = f"""
WITH records AS (
  SELECT page_id // {FILE_PAGES} AS file, page_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
placed AS (
  SELECT file, page_id, record, strlen(record) AS length,
         CAST(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id) - strlen(record) AS BIGINT) AS "offset" FROM records),
both_sides AS (
  SELECT file, "offset", length, record, page_id % 50 AS kind,
         CASE page_id % 50 WHEN 7 THEN left(record, length(record) - 5) || '~' || right(record, 4) WHEN 31 THEN 'w' || substr(record, 2) WHEN 23 THEN NULL ELSE record END AS other
  FROM placed)
SELECT file, "offset", length, CASE WHEN other IS NULL THEN 'missing' ELSE 'changed' END AS status, sha256(record) AS hash, sha256(other) AS other_hash
FROM both_sides WHERE record IS DISTINCT FROM other
"""
