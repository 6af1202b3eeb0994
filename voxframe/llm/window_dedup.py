"""Repeated word windows found by difference-cover anchors.

The positions of a document whose remainder modulo PERIOD lies in COVER are its anchors. COVER is a
difference cover: every difference modulo PERIOD is one of two of its members, so of any two equal windows
of WINDOW words, wherever they start, some anchors less than PERIOD words in are aligned. Only the
WINDOW - PERIOD + 1 words from each anchor are hashed and shuffled. Where such a hash occurs twice, the
windows that hold the anchor are extended to all their WINDOW words, and those are compared.

Anchors only propose windows, by a quick hash of their words. Windows are told apart by 128 bits of BLAKE2b over their
words' bytes, joined by spaces, for which no two inputs with equal digests can be constructed. A block of texts sends
on only one of its equal anchors or windows, marked as occurring more than once, so what a third of all texts
share costs a row for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, table
from .suffix_dedup import removed
from .textbytes import SpanHash, blocks, integers, runs, scattered, signed, spaced_words, whole_keys, word_spans
from .whole_texts import distinct_texts, first_copies, keyed_rows

WINDOW = 35
#: A perfect difference set: each of 1..20 is one difference of two members modulo 21.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)

#: Settled rows of so many words of a text are sent together.
SPREAD = 256
#: Rows of one hash that a task takes into memory at a time.
TASK_ROWS = 1 << 19

_WORD, _ONE = SpanHash(31), SpanHash(32)
#: Bytes of a window's digest, two numbers.
DIGEST = 16
U64 = np.uint64

_ROWS = "one long, two long, doc long, tag long, place long"
_ANCHOR_ROWS = "one long, doc long, tag long, place long"
#: Occurs once in its block; occurs more often there; the same, and settled: the block's first speaks for it.
ONCE, OFTEN, SETTLED = 0, 1, 2


def _combined(keys: list[np.ndarray], doc, tag, pos) -> pa.RecordBatch:
    """Rows in the order of the texts, which compresses best, each with its place and its state within the block as one number."""
    order = np.lexsort(keys[::-1])
    first = runs(*(k[order] for k in keys))
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, len(order)))
    state = np.empty(len(order), np.int64)
    state[order] = np.where(first, np.where(np.repeat(size, size) > 1, OFTEN, ONCE), SETTLED)
    # Settled rows meet no others, so they are spread evenly instead of going where their equals go.
    settled = state == SETTLED
    keys = [np.where(settled, scattered(doc, pos, SPREAD), keys[0]), *(np.where(settled, U64(0), k) for k in keys[1:])]
    columns = [*(pa.array(signed(k)) for k in keys), pa.array(doc), pa.array(tag), pa.array(pos.astype(np.int64) * 4 + state)]
    return pa.RecordBatch.from_arrays(columns, [*("one", "two")[: len(keys)], "doc", "tag", "place"])


def _word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of words before each text (and in all), and place of each word in its text."""
    words = word_spans(data, offsets)[2]
    return words, np.arange(words[-1]) - np.repeat(words[:-1], np.diff(words))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A quick hash of each word, and as :func:`_word_places`."""
    starts, ends, _ = word_spans(data, offsets)
    return _WORD.spans(_WORD.prefix(data), starts, ends), *_word_places(data, offsets)


def anchor_places(words: np.ndarray, place: np.ndarray, window: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Indices of words at anchors with window - period + 1 words from there on, in texts of a window at least."""
    count = np.diff(words)
    left = np.repeat(count, count) - place
    covered = np.zeros(period, bool)
    covered[list(cover)] = True
    return np.flatnonzero(covered[place % period] & (left >= window - period + 1) & (np.repeat(count, count) >= window))


def window_digests(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """BLAKE2b of the ``width`` words from each word ``at`` on, joined by spaces, as two numbers."""
    starts, ends, _ = word_spans(data, offsets)
    letters, bounds = spaced_words(data, starts, ends)
    raw, hashed = memoryview(letters), hashlib.blake2b
    digests = b"".join([hashed(raw[a:b], digest_size=DIGEST).digest() for a, b in zip(bounds[at].tolist(), (bounds[at + width] - 1).tolist())])
    return [np.ascontiguousarray(k) for k in np.frombuffer(digests, "<u8").reshape(-1, 2).T]


def _span_rows(rows: pa.RecordBatch, words: np.ndarray, at: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
    text = np.searchsorted(words, at, "right") - 1
    return _combined(keys, integers(rows, "doc")[text], integers(rows, "tag")[text], at - words[:-1][text])


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            hashes, words, place = _word_hashes(data, offsets)
            at = anchor_places(words, place, window, period, cover)
            if len(at):
                yield _span_rows(rows, words, at, [_ONE.spans(_ONE.prefix(hashes), at, at + window - period + 1)])

    return cut


def _places(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tag[at]), pa.array((place[at] >> 2).astype(np.int32))], ["doc", "tag", "pos"])


def _repeated(digits: tuple[str, ...]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by their first hash, those whose hashes occur more than once."""
        for rows, _ in whole_keys(batches, "one", TASK_ROWS):
            doc, tag, place = (integers(rows, c) for c in ("doc", "tag", "place"))
            settled, left = np.flatnonzero(place & 3 == SETTLED), np.flatnonzero(place & 3 != SETTLED)
            if not len(left):
                yield _places(doc, tag, place, settled)
                continue
            keys = [integers(rows, c)[left] for c in digits]
            order = np.lexsort(keys[::-1])
            head = np.flatnonzero(runs(*(k[order] for k in keys)))
            size = np.diff(np.append(head, len(order)))
            often = np.maximum.reduceat(place[left[order]] & 3, head) > ONCE
            yield _places(doc, tag, place, np.concatenate([settled, left[order[np.repeat((size > 1) | often, size)]]]))

    return found


def _occurring_twice(rows: DataFrame, *digits: str) -> DataFrame:
    return rows.repartition("one").sortWithinPartitions(*digits).mapInArrow(_repeated(digits), "doc long, tag long, pos int")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _extended(window: int, period: int):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words, place = _word_places(data, offsets)
            pos, text = _lists(rows.column(rows.schema.get_field_index("places")))
            # Windows start up to period - 1 words before an anchor that they hold.
            held = np.zeros(len(place) + 1, np.int64)
            anchor = words[:-1][text] + pos
            np.add.at(held, np.maximum(anchor - period + 1, words[:-1][text]), 1)
            np.add.at(held, anchor + 1, -1)
            count = np.diff(words)
            whole = np.repeat(count, count) - place >= window
            at = np.flatnonzero((np.cumsum(held[:-1]) > 0) & whole)
            if len(at):
                yield _span_rows(rows, words, at, window_digests(data, offsets, at, window))

    return extend


def repeated_windows(texts: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(doc, tag, pos): windows of distinct texts whose words also start elsewhere, by the place of their first word."""
    plain = texts.select("doc", "tag", "text")
    # Anchors only propose windows, so one hash is enough for them.
    anchors = _occurring_twice(plain.mapInArrow(_anchors(window, period, cover), _ANCHOR_ROWS), "one")
    places = anchors.groupBy("doc", "tag").agg(F.collect_list("pos").alias("places"))
    return _occurring_twice(plain.join(places.hint("merge"), ["doc", "tag"]).mapInArrow(_extended(window, period), _ROWS), "one", "two")


_CUT = "sha string, n_words long, n_removed long, kept_sha256 string, kept binary"


def _cut_out(window: int, with_text: bool):
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            starts, ends, words = word_spans(data, offsets)
            pos, text = _lists(rows.column(rows.schema.get_field_index("marks")))
            copies, raw, out = integers(rows, "copies"), data.tobytes(), []
            bounds = np.searchsorted(text, np.arange(rows.num_rows + 1))
            for row in range(rows.num_rows):
                a, b = words[row], words[row + 1]
                if copies[row] > 1 and b - a >= window:
                    gone = np.ones(b - a, bool)  # all its windows also start in its copy
                else:
                    own = pos[bounds[row] : bounds[row + 1]]
                    gone = removed(b - a, np.stack([own, np.ones_like(own)], axis=1), window)
                left = b"\x20".join([raw[x:y] for x, y in zip(starts[a:b][~gone].tolist(), ends[a:b][~gone].tolist())])
                out.append((int(b - a), int(gone.sum()), hashlib.sha256(left).hexdigest(), left if with_text else None))
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["sha", "n_words", "n_removed", "kept_sha256", "kept"])

    return cut


def remove_windows(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = True) -> DataFrame:
    """Every document without the words of its repeated windows.

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in the same
    document too; so all occurrences go. Returns doc_id, n_words, n_removed, kept_sha256 and kept (the
    remaining words joined by one space; null unless ``with_text``), one row for each row of ``docs``.
    Null texts have no word. Repeated rows are copies of each other, whatever their doc_id, null too.
    Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = keyed_rows(docs)
    texts = distinct_texts(docs, first_copies(rows))
    marks = repeated_windows(texts, window, period, cover).groupBy("doc", "tag").agg(F.collect_list("pos").alias("marks"))
    cut = texts.join(marks.hint("merge"), ["doc", "tag"], "left").select("sha", "copies", "text", "marks").mapInArrow(_cut_out(window, with_text), _CUT)
    return rows.select("doc_id", "sha").join(cut.hint("merge"), "sha").drop("sha")


def op5(spark, sf_dir: str) -> DataFrame:
    return remove_windows(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


OP5_SQL = rf"""
WITH texts AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM texts),
windows AS (SELECT r, p, w, n, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s FROM words),
marked AS (SELECT r, p, w, p + {WINDOW - 1} <= n AND count(*) FILTER (p + {WINDOW - 1} <= n) OVER (PARTITION BY s) > 1 AS again FROM windows),
covered AS (SELECT r, p, w, bool_or(again) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
sums AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM covered GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN sums USING (r)
"""
