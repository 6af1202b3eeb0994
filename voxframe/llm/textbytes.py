"""Vectorised work on the UTF-8 bytes of Arrow text columns.

A block of texts is one byte array plus offsets, so words, hashes of spans and sliding minima of
all its texts are computed by a few numpy calls, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text makes a block of its own.
BLOCK_BYTES = 2 << 20

#: Separators of words: space, tab, newline, vertical tab, form feed, carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U64 = np.uint64


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its values; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``limit`` bytes of text: rows, their bytes, their offsets."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at, rows = 0, batch.num_rows
        while at < rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(rows, max(to, at + 1))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def integers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and how many words come before each text (and in all)."""
    inside = ~SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    bounds = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] < offsets[1:])]
    first[bounds] |= inside[bounds]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] |= inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spaced_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, each with a space behind it, and the offset of each (and of the end)."""
    sizes = ends - starts
    letters = data[~SEPARATOR[data]]
    out = np.full(len(letters) + len(sizes), 0x20, np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = letters
    return out, np.append(0, np.cumsum(sizes + 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class SpanHash:
    """64-bit polynomial hash (modulo 2**64) of any span of a sequence, from prefix sums.

    The value of a span doesn't depend on where it stands: powers of the odd base are inverted modulo 2**64.
    """

    def __init__(self, seed: int):
        self.base = int(mixed(np.array([seed], U64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.values = mixed(np.arange(1, 257, dtype=U64) * U64(self.base))
        self.power = self.back = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            n = 1 << (n - 1).bit_length()
            self.power = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, self.base, U64))])
            self.back = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, self.inverse, U64))])

    def prefix(self, items: np.ndarray) -> np.ndarray:
        """Prefix sums over bytes, or over 64-bit values."""
        self._grow(len(items) + 1)
        out = np.zeros(len(items) + 1, U64)
        np.cumsum((self.values[items] if items.dtype == np.uint8 else items) * self.power[: len(items)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(((prefix[ends] - prefix[starts]) * self.back[starts]) ^ (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all spans of one width, by start."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, U64)
        return mixed((prefix[width:] - prefix[:-width]) * self.back[:n])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have :])
    return out


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted sequence of keys begins a new value."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = False
        for key in keys:
            first[1:] |= key[1:] != key[:-1]
    return first


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, limit: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Regroup the batches of a partition sorted by ``key`` so that no value of it is cut in two.

    A value of more than ``limit`` rows comes in parts of about that size, each but the first beginning with
    the last row of the one before, and is marked so.
    """
    held: list[pa.RecordBatch] = []
    rows, cut_up = 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        values = integers(batch, key)
        if held and integers(held[-1], key)[-1] != values[0]:
            yield pa.Table.from_batches(held), cut_up
            held, rows, cut_up = [], 0, False
        if values[0] != values[-1]:
            cut = int(np.flatnonzero(values != values[-1])[-1]) + 1
            head = int(np.flatnonzero(values != values[0])[0])
            if cut_up:
                yield pa.Table.from_batches([*held, batch.slice(0, head)]), True
                held, cut_up = [], False
                if cut > head:
                    yield pa.Table.from_batches([batch.slice(head, cut - head)]), False
            else:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]), False
            held, rows = [batch.slice(cut)], batch.num_rows - cut
        else:
            held.append(batch)
            rows += batch.num_rows
        if limit is not None and rows > limit:
            yield pa.Table.from_batches(held), True
            held, rows, cut_up = [held[-1].slice(held[-1].num_rows - 1)], 1, True
    if held:
        yield pa.Table.from_batches(held), cut_up


def scattered(doc: np.ndarray, pos: np.ndarray, span: int) -> np.ndarray:
    """A hash of a place, to spread rows that need not meet others; places of one ``span`` stay together, which compresses well."""
    return mixed(doc.astype(U64) * U64(0x9E3779B97F4A7C15) + (pos // span).astype(U64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)
