"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first DEPTH bytes, by most-significant-digit passes, and a suffix
leaves the sort as soon as it stands alone or its group is known to be equal through DEPTH:

1. The first digit of a suffix is the least of the GRAM-byte grams in its first DEPTH bytes (by hash) with
   its place. Neighbouring suffixes share it, so a run of them, and not each suffix, is one row of the
   shuffle. Suffixes whose gram occurs nowhere else are alone.
2. The second digit is the whole of the run's bytes. Runs that agree in it agree in all their suffixes:
   all but the first run are repeats, as whole runs. Of runs of equal gram and unequal bytes, only first ones
   go on, and of these only the quarters whose suffixes have the bytes around the gram, by a short hash, in
   common with another run's.
3. Each STEP neighbouring suffixes are then treated as runs were: the bytes that all of them hold are their
   third digit, and all their bytes the fourth. Equal ones are repeats as a whole but for the first.
4. The suffixes that are left are ordered one by one by all DEPTH bytes; in each group all but the first
   are repeats.

Grams that a share of FREQUENT of all runs have, or about TASK_ROWS of them, found on a sample, would gather in
one task: their suffixes skip to the last pass, where only equal ones meet. Whether a gram is on this list
changes the way, not the result, and the list has a bound of its own, MOST.

Digits that settle suffixes are a quick hash of 64 bits and 64 bits of BLAKE2b, compared together; those of the last pass are 128 bits of
BLAKE2b over the suffix's DEPTH bytes, for which no two inputs with equal digests can be constructed. Each pass is a shuffle by digit and a sort
within partitions. A block of texts first sorts its own runs and sends only the first of equal ones on, so a
string that a third of all texts hold costs a few rows for each task. The passes follow each other in one
plan, so the texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, table, text_or_empty
from .textbytes import SpanHash, blocks, integers, runs, scattered, signed, sliding_minimum, whole_keys
from .whole_texts import distinct_texts, first_copies, keyed_rows

DEPTH, GRAM = 100, 20
#: Parts of a run's suffixes that the second pass tells apart, and suffixes that share a row of the third.
QUARTERS, STEP = 4, 8
#: Settled rows of so many bytes of a text are sent together.
SPREAD = 8192
#: Rows of one digit that a task takes into memory at a time.
TASK_ROWS = 1 << 19

_ONE = SpanHash(21)
U64 = np.uint64

#: What a row says of the suffixes that start at pos..pos+n-1 of a text: not settled, repeats, to be sorted
#: further, to be sorted in the last pass.
OPEN, REPEAT, SINGLY, DIRECT = 0, 1, 2, 3

#: Grams of this share of the sampled runs are frequent, and all of TASK_ROWS runs or more; one text in SAMPLED is looked
#: at, SEEN runs at least make a gram frequent, and the MOST frequent ones are listed, 8 MB.
FREQUENT, SAMPLED, SEEN, MOST = 1 / 4096, 64, 64, 1 << 20


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of spans of bytes, as two numbers."""
    raw, hashed = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    digests = b"".join([hashed(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def quarter_hashes(one: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, gram: int) -> np.ndarray:
    """Four 16-bit hashes for each run, of the bytes that its suffixes of a quarter have in common; zero beyond the text.

    A suffix that starts d bytes before the gram, d in the k-th quarter, holds k quarters of depth - gram
    bytes before the gram and the bytes after it up to depth less the k + 1 quarters.
    """
    part = -(-(depth - gram) // QUARTERS)
    out = np.zeros(len(anchor), U64)
    for k in range(QUARTERS):
        start, end = anchor - k * part, anchor + max(gram, depth - (k + 1) * part)
        whole = (start >= low) & (end <= high)
        h = _ONE.spans(one, np.where(whole, start, 0), np.where(whole, end, 0)) >> U64(48)
        out |= np.where(whole, h, U64(0)) << U64(16 * k)
    return out


def suffix_runs(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of suffixes of one first digit: gram hash, hash of the run's bytes, quarter hashes, row of the text,
    start in it, suffixes, and bytes from the first one to the gram."""
    none = tuple(np.zeros(0, t) for t in (U64, U64, U64, np.int64, np.int64, np.int64, np.int64))
    if len(data) < depth:
        return none
    one = _ONE.prefix(data)
    grams = _ONE.windows(one, gram)
    bits = int(len(grams)).bit_length()
    # The place in the lower bits finds the leftmost of equal grams.
    packed = (grams & ~U64((1 << bits) - 1)) | np.arange(len(grams), dtype=U64)
    least = (sliding_minimum(packed, depth - gram + 1) & U64((1 << bits) - 1)).astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - depth + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[:-1][text]
    if not len(start):
        return none
    anchor = least[start]
    head = np.flatnonzero(runs(anchor))
    count = np.diff(np.append(head, len(start)))
    first, anchor, text = start[head], anchor[head], text[head]
    quarters = quarter_hashes(one, anchor, offsets[:-1][text], offsets[1:][text], depth, gram)
    return grams[anchor], span_digests(data, first, first + count - 1 + depth)[0], quarters, text, first - offsets[:-1][text], count, anchor - first


def settle(one: np.ndarray, two: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by digits and then by place; and where in this order a group of equal digits begins."""
    order = np.lexsort((pos, tag, doc, two, one))
    return order, runs(one[order], two[order])


def _block_state(one: np.ndarray, two: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """OPEN for the first of equal digits, REPEAT for the others."""
    order, first = settle(one, two, doc, tag, pos)
    state = np.empty(len(order), np.int64)
    state[order] = np.where(first, OPEN, REPEAT)
    return state


# Rows carry what they say of suffixes as one number, as rows are what the shuffles move: pos, n, the bytes
# from the first suffix to the gram and the state; for repeats, whose n has no bound, pos, n and the state.
def pack_place(pos: np.ndarray, n: np.ndarray, before: np.ndarray, state: np.ndarray) -> np.ndarray:
    pos, n = pos.astype(np.int64), n.astype(np.int64)
    return np.where(state == REPEAT, pos << 32 | n << 2, pos << 18 | n << 10 | before << 2) | state


def repeats(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    return pos.astype(np.int64) << 32 | n.astype(np.int64) << 2 | REPEAT


def unpack_repeats(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> 32, (place >> 2) & ((1 << 30) - 1)


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 18, (place >> 10) & 255, (place >> 2) & 255


_RUNS = "one long, two long, quarters long, doc long, tag long, place long"
_ROWS = "one long, two long, doc long, tag long, place long"
_MARKS = "doc long, tag long, place long"


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(c)) if c.dtype == U64 else pa.array(c.astype(np.int64, copy=False)) for c in columns], [f.split()[0] for f in names.split(", ")])


def _columns(rows: pa.Table, names: str) -> list[np.ndarray]:
    return [integers(rows, f.split()[0]) for f in names.split(", ")]


def frequent_grams(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> np.ndarray:
    """First digits, sorted, that occur in many different runs of a sample of the texts; at most MOST."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in blocks(batches):
            one, two, _, text, pos, _, _ = suffix_runs(data, offsets, depth, gram)
            found, n = np.unique(one[_block_state(one, two, text, text, pos) == OPEN], return_counts=True)
            # All runs are counted in the row of no gram.
            kept = n > 1
            yield pa.RecordBatch.from_arrays([pa.array([*signed(found[kept]).tolist(), None], pa.int64()), pa.array(np.append(n[kept], n.sum()))], ["one", "n"])

    texts = docs.select(text_or_empty().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = texts.mapInArrow(count, "one long, n long").groupBy("one").agg(F.sum("n").alias("n")).where(f"one IS NULL OR n >= {SEEN}")
    # The row of no gram, the sum of all, comes first. No null reaches pandas, which would make the grams floats.
    counts = counts.select(F.col("one").isNull().alias("all"), F.coalesce("one", F.lit(0)).alias("one"), "n")
    largest = counts.orderBy(F.desc("n"), F.desc("all")).limit(MOST + 1).toPandas()
    total = largest.loc[largest["all"], "n"].sum()
    grams = largest.loc[~largest["all"] & (largest["n"] >= min(FREQUENT * total, TASK_ROWS / SAMPLED)), "one"]
    return np.sort(grams.to_numpy(np.int64).view(U64))


def _listed(one: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which values are on the sorted list."""
    if not len(frequent):
        return np.zeros(len(one), bool)
    return frequent[np.minimum(np.searchsorted(frequent, one), len(frequent) - 1)] == one


def _first_pass(depth: int, gram: int, frequent: np.ndarray | Broadcast):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = frequent.value if isinstance(frequent, Broadcast) else frequent
        for rows, data, offsets in blocks(batches):
            one, two, quarters, text, pos, n, before = suffix_runs(data, offsets, depth, gram)
            doc, tag = integers(rows, "doc")[text], integers(rows, "tag")[text]
            state = _block_state(one, two, doc, tag, pos)
            state[(state == OPEN) & _listed(one, grams)] = DIRECT
            # Rows leave in the order of the texts, which compresses best. Settled ones are spread evenly.
            settled = state != OPEN
            one = np.where(settled, scattered(doc, pos, SPREAD), one)
            two[settled] = quarters[settled] = 0
            yield _batch(_RUNS, one, two, quarters, doc, tag, pack_place(pos, n, before, state))

    return cut


def _counts(*keys: np.ndarray) -> np.ndarray:
    """For each element how many have its keys."""
    order = np.lexsort(keys)
    head = np.flatnonzero(runs(*(k[order] for k in keys)))
    size = np.diff(np.append(head, len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(size, size)
    return out


def _per_key(key: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """For each row of a sorted key how many of its rows are counted."""
    head = np.flatnonzero(runs(key))
    if not len(head):
        return np.zeros(0, np.int64)
    return np.repeat(np.add.reduceat(counted.astype(np.int64), head), np.diff(np.append(head, len(key))))


def _second_pass(depth: int, gram: int):
    part = -(-(depth - gram) // QUARTERS)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cut_up in whole_keys(batches, "one", TASK_ROWS):
            columns = _columns(rows, _RUNS)
            done = columns[-1] & 3 != OPEN
            yield _batch(_MARKS, *(c[done] for c in columns[3:]))
            one, two, quarters, doc, tag, place = (c[~done] for c in columns)
            if not len(one):
                continue
            first = runs(one, two)
            pos, n, before = unpack_place(place)
            yield _batch(_MARKS, doc[~first], tag[~first], repeats(pos[~first], n[~first]))
            # A gram too frequent to be seen at once goes to the next pass as it is.
            single = np.flatnonzero(first if cut_up else first & (_per_key(one, first) > 1))
            for k in range(QUARTERS):
                # Suffixes that start part*k .. part*(k+1) - 1 bytes before the gram, the last quarter to its end.
                near, far = part * k, part * (k + 1) - 1 if k < QUARTERS - 1 else depth
                start = np.maximum(pos[single], pos[single] + before[single] - far)
                end = np.minimum(pos[single] + n[single] - 1, pos[single] + before[single] - near)
                some = start <= end
                if not cut_up:
                    own = np.flatnonzero(some)
                    some[own] = _counts((quarters[single[own]] >> (16 * k)) & 0xFFFF, one[single[own]]) > 1
                row, start, end = single[some], start[some], end[some]
                yield _batch(_MARKS, doc[row], tag[row], pack_place(start, end - start + 1, before[row] - (start - pos[row]), np.full(len(row), SINGLY)))

    return sort


def _list(column: pa.Array, row: int) -> np.ndarray:
    """The numbers of a list column in one row."""
    value = column[row].values
    return np.zeros(0, np.int64) if value is None else value.to_numpy(zero_copy_only=False)


def merged(pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same starts in as few runs (pos, n) as there can be."""
    order = np.argsort(pos, kind="stable")
    pos, reach = pos[order], np.maximum.accumulate((pos + n)[order])
    head = np.flatnonzero(np.append(True, pos[1:] > reach[:-1])[: len(pos)])
    tail = np.append(head[1:], len(pos))[: len(head)] - 1
    return pos[head], reach[tail] - pos[head]


def _refine(depth: int, step: int):
    """Rows for each ``step`` neighbouring suffixes that aren't settled: hashes of what all of them hold, and of all their bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            column = rows.column(rows.schema.get_field_index("places"))
            doc, tag = integers(rows, "doc"), integers(rows, "tag")
            settled, texts, places, waiting = [], [], [], []
            for row in range(rows.num_rows):
                place = _list(column, row)
                again = place & 3 == REPEAT
                pos, n = merged(*unpack_repeats(place[again]))
                settled.append((np.full(len(pos), row), pos, n))
                left = np.unique(place[~again])  # one digit's rows may come in overlapping parts
                direct = left & 3 == DIRECT if step > 1 else np.zeros(len(left), bool)
                waiting.append((np.full(direct.sum(), row), left[direct]))
                places.append(left[~direct])
                texts.append(np.full(len(places[-1]), row))
            row, pos, n = (np.concatenate(c) for c in zip(*settled))
            # Settled rows only pass through, spread evenly.
            yield _batch(_ROWS, scattered(doc[row], pos, SPREAD), np.zeros(len(row), np.int64), doc[row], tag[row], repeats(pos, n))
            row, place = (np.concatenate(c) for c in zip(*waiting))
            yield _batch(_ROWS, scattered(doc[row], place >> 18, SPREAD), np.zeros(len(row), np.int64), doc[row], tag[row], place)
            text, (pos, n, before) = np.concatenate(texts), unpack_place(np.concatenate(places))
            # Pieces by the distance to the gram, which equal suffixes have in common: step*j .. step*(j+1) - 1.
            low, high = (before - n + 1) // step, before // step
            pieces = high - low + 1
            of = np.repeat(np.arange(len(pos)), pieces)
            j = np.repeat(low, pieces) + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            near = np.maximum(step * j, (before - n + 1)[of])
            far = np.minimum(step * (j + 1) - 1, before[of])
            text, start = text[of], pos[of] + before[of] - far
            whole = offsets[:-1][text] + start
            other, two = span_digests(data, whole, whole + far - near + depth)
            if step > 1:
                common = offsets[:-1][text] + pos[of] + before[of] - step * j
                one = _ONE.spans(_ONE.prefix(data), common, common + depth - step + 1)
            else:
                one = other  # all suffixes of a row, that is its one, have these bytes in common
            state = _block_state(one, two, doc[text], tag[text], start)
            one = np.where(state == REPEAT, scattered(doc[text], start, SPREAD), one)
            two[state == REPEAT] = 0
            yield _batch(_ROWS, one, two, doc[text], tag[text], pack_place(start, far - near + 1, far, state))

    return cut


def _third_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, cut_up in whole_keys(batches, "one", TASK_ROWS):
        one, two, doc, tag, place = _columns(rows, _ROWS)
        done = np.flatnonzero(place & 3 != OPEN)
        left = np.flatnonzero(place & 3 == OPEN)
        first = runs(one[left], two[left])
        again = left[~first]
        # One of several contents of a digit may still hold suffixes of another; a digit too frequent to be seen at once too.
        single = left[first if cut_up else first & (_per_key(one[left], first) > 1)]
        state = np.concatenate([place[done], repeats(*unpack_place(place[again])[:2]), place[single] - OPEN + SINGLY])
        yield _batch(_MARKS, *(np.concatenate([c[done], c[again], c[single]]) for c in (doc, tag)), state)


def _last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _ in whole_keys(batches, "one", TASK_ROWS):
        one, two, doc, tag, place = _columns(rows, _ROWS)
        done = np.flatnonzero(place & 3 == REPEAT)
        left = np.flatnonzero(place & 3 == OPEN)
        left = left[~runs(one[left], two[left])]
        yield _batch(_MARKS, *(np.concatenate([c[done], c[left]]) for c in (doc, tag)), np.concatenate([place[done], repeats(*unpack_place(place[left])[:2])]))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows dealt by their first digit and ordered by both, then by place."""
    return rows.repartition("one").sortWithinPartitions("one", "two", "doc", "tag", "place")


def _with_places(texts: DataFrame, marks: DataFrame, how: str = "inner") -> DataFrame:
    """The texts that are marked (or all), each with its marks, as a list."""
    return texts.join(marks.groupBy("doc", "tag").agg(F.collect_list("place").alias("places")).hint("merge"), ["doc", "tag"], how)


def repeat_marks(texts: DataFrame, depth: int, gram: int, frequent: np.ndarray) -> DataFrame:
    """(doc, tag, place): suffixes that repeat, through ``depth``, one that starts earlier; see :func:`unpack_repeats`."""
    plain = texts.select("doc", "tag", "text")
    frequent = texts.sparkSession.sparkContext.broadcast(frequent)
    marks = _sorted(plain.mapInArrow(_first_pass(depth, gram, frequent), _RUNS)).mapInArrow(_second_pass(depth, gram), _MARKS)
    marks = _sorted(_with_places(plain, marks).mapInArrow(_refine(depth, STEP), _ROWS)).mapInArrow(_third_pass, _MARKS)
    return _sorted(_with_places(plain, marks).mapInArrow(_refine(depth, 1), _ROWS)).mapInArrow(_last_pass, _MARKS)


_CUT = "sha string, doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removed(size: int, pairs: np.ndarray, width: int) -> np.ndarray:
    """Which of ``size`` units are covered by the windows of ``width`` at pos..pos+n-1 for each (pos, n)."""
    depths = np.zeros(size + 1, np.int64)
    np.add.at(depths, pairs[:, 0], 1)
    np.add.at(depths, pairs[:, 0] + pairs[:, 1] - 1 + width, -1)
    return np.cumsum(depths[:-1]) > 0


def _cut_out(depth: int, with_text: bool):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["sha", "doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            places, out = rows.column(rows.schema.get_field_index("places")), []
            for row in range(rows.num_rows):
                text = data[offsets[row] : offsets[row + 1]]
                gone = removed(len(text), np.stack(unpack_repeats(_list(places, row)), axis=1), depth)
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = text[~gone].tobytes()
                out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names)

    return cut


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Every document without the bytes of its repeated strings.

    A byte goes if a string of ``depth`` bytes that covers it also starts earlier: in a smaller doc_id, or
    in the same document. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    and kept (the remaining bytes, joined; null unless ``with_text``), one row for each row of ``docs``.
    Null texts are empty. A null doc_id sorts after all others; rows that repeat a text under one doc_id
    all give the first one's row; different texts of one doc_id count as different documents, ordered by
    hash. Other columns are ignored.
    """
    if not 0 < gram <= depth < 256:
        raise ValueError("depth must be below 256, and a gram within it")
    prepare(docs.sparkSession)
    rows = keyed_rows(docs)
    texts = distinct_texts(docs, first_copies(rows))
    marked = _with_places(texts, repeat_marks(texts, depth, gram, frequent_grams(docs, depth, gram)), "left")
    cut = marked.select("sha", "doc", "text", "places").mapInArrow(_cut_out(depth, with_text), _CUT)
    own = rows.select("doc_id", F.col("doc").alias("row_doc"), "sha").join(cut.hint("merge"), "sha")
    # A later copy of a whole text repeats all of it, if it has a string of this length at all.
    again = (F.col("row_doc") != F.col("doc")) & (F.col("n_bytes") >= depth)
    return own.select(
        "doc_id",
        "n_bytes",
        F.when(again, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(again, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(F.col("kept").isNotNull() & again, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


OP4_SQL = f"""
WITH texts AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
bytes AS (SELECT r, p, hex(b[p : p]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) + 1)) AS p FROM texts)),
windows AS (SELECT r, p, h, string_agg(h, '') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {DEPTH - 1} FOLLOWING) AS w FROM bytes),
marked AS (SELECT r, p, h, strlen(w) = {2 * DEPTH} AND row_number() OVER (PARTITION BY w ORDER BY r, p) > 1 AS again FROM windows),
covered AS (SELECT r, p, h, bool_or(again) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {DEPTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM covered),
sums AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(h, '' ORDER BY p) FILTER (NOT gone) AS kept FROM edges GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM texts LEFT JOIN sums USING (r)
"""
