"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the counts of set bits in its segments of two bits. The Manhattan distance of
two such vectors is a lower bound of the fingerprints' Hamming distance, so the join within RADIUS bits is a
range join in the space of counts. Counts are written in unary, 00, 01 and 11, so that a vector is again one
64-bit number and the Manhattan distance of two is the number of bits in which they differ.

The space is cut into BLOCKS blocks of coordinates: if the distance is at most RADIUS, at least BLOCKS - RADIUS
blocks agree. For each choice of that many blocks their counts are a grid cell, and only fingerprints of one
cell are compared: first by Manhattan distance, then exactly by Hamming distance.

Counts crowd in the middle, so cells are uneven. A cell of more than CELL_ROWS fingerprints is divided by the
bits of the blocks chosen: as RADIUS bits touch at most RADIUS blocks, any two near fingerprints agree in the
bits, and not only in the counts, of some choice of blocks, so dividing cells loses no link. Such cells are looked for
on a sample of the fingerprints first, and their parts are dealt to tasks of their own; whether a cell is on this list changes where it
is worked on, not what is found.

Equal fingerprints are one node from the start. Within a cell a breadth-first search compares each node it
reaches only with those not yet reached and returns one link for each, so a cell of n near copies costs
about n links and no list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import checkpointed, prepare, table, text_or_empty
from .textbytes import blocks, integers, mixed, runs, signed, word_spans

SHINGLE_WORDS, RADIUS = 4, 4
BLOCKS = 8
XXH_SEED = 42
#: Fingerprints of a cell up to which they are compared as they are, and that are compared with one at a time.
CELL_ROWS, CHUNK = 8192, 1 << 16
#: Lower bits of a key that tell the parts of a cell.
PART_BITS = 24
#: One fingerprint in SAMPLED is looked at for large cells, and so many of them are listed at the most, 512 KB.
SAMPLED, LISTED = 64, 1 << 16

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints of the block's texts; a text without words has fingerprint zero."""
    starts, ends, words = word_spans(data, offsets)
    out = np.zeros(len(offsets) - 1, U64)
    if not len(starts):
        return out
    # The words joined by one space each, as one array of bytes for the whole block.
    lengths = ends - starts
    place = np.concatenate([[0], np.cumsum(lengths + 1)])
    take = np.repeat(starts - place[:-1], lengths + 1) + np.arange(place[-1])
    joined = LOWER[data[np.minimum(take, len(data) - 1)]]
    joined[place[1:] - 1] = 0x20
    raw = joined.tobytes()
    count = np.diff(words)
    shingles = np.where(count > 0, np.maximum(1, count - shingle + 1), 0)
    of = np.repeat(np.arange(len(count)), shingles)
    first = np.repeat(words[:-1], shingles) + np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(first + shingle, words[1:][of])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], XXH_SEED) for a, b in zip(place[first].tolist(), (place[last] - 1).tolist())], U64)
    # Bits are summed eight at a time: each of 8 bytes of a word counts one bit, 255 shingles at most.
    ends_at = np.cumsum(shingles)
    for d in np.flatnonzero(shingles).tolist():
        bits = np.unpackbits(h[ends_at[d] - shingles[d] : ends_at[d]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = bits.sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(2 * ones > shingles[d], bitorder="little").view(U64)[0]
    return out


def embedded(fps: np.ndarray) -> np.ndarray:
    """The counts of set bits in the 32 segments of each fingerprint, in unary."""
    odd = U64(0x5555555555555555)
    low, high = fps & odd, fps >> U64(1) & odd
    return (low | high) | (low & high) << U64(1)


def cell_keys(fps: np.ndarray, radius: int = RADIUS, block_count: int = BLOCKS) -> Iterator[np.ndarray]:
    """For each choice of blocks that must agree, the keys of the fingerprints' cells; the lower PART_BITS tell the bits of these blocks."""
    counts, width = embedded(fps), 64 // block_count
    mask, golden = U64((1 << width) - 1), U64(0x9E3779B97F4A7C15)
    block = [(counts >> U64(b * width) & mask, fps >> U64(b * width) & mask) for b in range(block_count)]
    low = U64((1 << PART_BITS) - 1)
    for number, chosen in enumerate(combinations(range(block_count), block_count - radius)):
        cell = np.full(len(fps), number + 1, U64)
        part = np.zeros(len(fps), U64)
        for b in chosen:
            cell = mixed(cell * golden + block[b][0])
            part = mixed(part * golden + block[b][1])
        yield cell & ~low | part & low


def _spanning_links(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one cell: each reached node is compared with all not yet reached."""
    counts = embedded(fps)
    left, links = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at, kept = queue.pop(), []
            for k in range(0, len(left), CHUNK):
                some = left[k : k + CHUNK]
                near = np.bitwise_count(counts[some] ^ counts[at]) <= radius
                near[near] = np.bitwise_count(fps[some[near]] ^ fps[at]) <= radius
                found = some[near]
                kept.append(some[~near] if len(found) else some)
                if len(found):
                    links.append((np.full(len(found), fps[at]), fps[found]))
                    queue += found.tolist()
            left = np.concatenate(kept)
    return links


def cell_links(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal cells of sorted keys; a large cell is taken part by part."""
    cell = key >> U64(PART_BITS)
    start = np.flatnonzero(runs(cell))
    size = np.diff(np.append(start, len(key)))
    large = np.flatnonzero(size > CELL_ROWS)
    if len(large):
        # Parts of large cells stand for cells of their own.
        apart = np.repeat(size > CELL_ROWS, size)
        start = np.flatnonzero(runs(cell, np.where(apart, key, U64(0))))
        size = np.diff(np.append(start, len(key)))
    pairs = start[size == 2]
    left, right = [fp[pairs]], [fp[pairs + 1]]
    for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        for x, y in _spanning_links(fp[a : a + n], radius):
            left.append(x)
            right.append(y)
    x, y = np.concatenate(left), np.concatenate(right)
    bound = np.bitwise_count(embedded(x) ^ embedded(y)) <= radius
    x, y = x[bound], y[bound]
    near = np.bitwise_count(x ^ y) <= radius
    return x[near], y[near]


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and fingerprints of a partition regrouped so that no cell is cut, or, once it is large, no part of one."""
    keys, fps, rows, parts = [], [], 0, False
    for batch in batches:
        key, fp = integers(batch, "key").view(U64), integers(batch, "fp").view(U64)
        while len(key):
            # Where the batch may be cut: at the last change of cell, or of part within a large cell.
            unit = key if parts else key >> U64(PART_BITS)
            held = keys[-1][-1] if keys else key[0]
            held = held if parts else held >> U64(PART_BITS)
            changes = np.flatnonzero(np.append(unit[:1] != held, unit[1:] != unit[:-1]))
            if not len(changes):
                keys.append(key)
                fps.append(fp)
                rows += len(key)
                if parts or rows <= CELL_ROWS:
                    break
                # The cell is large: what is held goes on part by part.
                key, fp = np.concatenate(keys), np.concatenate(fps)
                keys, fps, rows, parts = [], [], 0, True
                continue
            at = int(changes[-1])
            if at:
                keys.append(key[:at])
                fps.append(fp[:at])
            yield np.concatenate(keys), np.concatenate(fps)
            before = keys[-1][-1]
            key, fp, keys, fps, rows = key[at:], fp[at:], [], [], 0
            parts = parts and key[0] >> U64(PART_BITS) == before >> U64(PART_BITS)
    if keys:
        yield np.concatenate(keys), np.concatenate(fps)


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed 64-bit integer, and ``keep``, columns of type long, of every whole text."""
    prepare(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            kept = rows.columns[2:]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(signed(fingerprints(data, offsets, shingle))), *kept], ["doc_id", "fp", *keep])

    schema = ", ".join(["doc_id long", "fp long", *[f"{c} long" for c in keep]])
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *keep).mapInArrow(made, schema)


def large_cells(nodes: DataFrame, radius: int = RADIUS) -> np.ndarray:
    """Cells, sorted, that hold about CELL_ROWS fingerprints or more as far as a sample tells; at most LISTED."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for key in cell_keys(integers(rows, "fp").view(U64), radius):
                cell, n = np.unique(key >> U64(PART_BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(cell)), pa.array(n)], ["cell", "n"])

    sample = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)
    counts = sample.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, CELL_ROWS // SAMPLED // 2))
    found = counts.orderBy(F.desc("n"), "cell").limit(LISTED).select("cell").collect()  # LISTED numbers
    return np.sort(np.array([r["cell"] for r in found], np.int64).view(U64))


def routes(key: np.ndarray, large: np.ndarray) -> np.ndarray:
    """What keys are dealt to tasks by: their cell, or, for the listed ones, their cell and part."""
    cell = key >> U64(PART_BITS)
    if not len(large):
        return cell
    listed = large[np.minimum(np.searchsorted(large, cell), len(large) - 1)] == cell
    return np.where(listed, mixed(key), cell)


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct fingerprints of ``nodes(fp)`` within ``radius`` bits."""
    large = nodes.sparkSession.sparkContext.broadcast(large_cells(nodes, radius))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = integers(rows, "fp")
            for key in cell_keys(fps.view(U64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(signed(routes(key, large.value))), pa.array(signed(key)), pa.array(fps)], ["route", "key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in whole_cells(batches):
            x, y = map(signed, cell_links(key, fp, radius))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    cells = nodes.mapInArrow(keyed, "route long, key long, fp long").repartition("route").select("key", "fp").sortWithinPartitions("key")
    return cells.mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its fingerprint and the component of near-duplicates that it belongs to.

    Returns doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links of
    at most ``radius`` differing bits reach from it, and ``keep``, columns of type long that go along. Null
    texts are empty; texts without words have fingerprint zero and link like others. Repeated rows give
    repeated rows. A null doc_id never names a component unless all doc_ids of the component are null. Other
    columns of ``docs`` are ignored.
    """
    prints = checkpointed(fingerprint_table(docs, shingle, keep))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = fingerprint_links(nodes.select("fp"), radius)
    labels = connected_components(links)
    joined = checkpointed(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(smallest, "component").select("fp", "component_id")
    # One fingerprint may stand for a third of all documents; the sort-merge join splits such a partition.
    return prints.join(named.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *keep)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whatever these are named, but for those whose component holds a smaller doc_id.

    So of each component the smallest doc_id stays. Rows that repeat each other stay or go together; rows
    without doc_id stay, as there is nothing to rank them by.
    """
    text = text_or_empty()
    named = near_duplicates(docs.select("doc_id", "text", F.xxhash64(text).alias("tag")), keep=("tag",))
    # Text and doc_id together name a row's component; the hash is of texts of one doc_id only.
    gone = named.where("doc_id > component_id").select(F.col("doc_id").alias("doc"), "tag").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("tag"))
    return rows.join(gone, ["doc", "tag"], "left_anti").select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
