"""Periodic runs of words: maximal stretches that repeat themselves at a fixed distance.

For each period p the places jp form a grid. A run of period p and of 2p words at least holds two neighbours
of it, jp and (j+1)p, so the words that follow both alike, and those that come before both alike, give the whole run: two queries
for a longest common extension. A suffix array with the common prefixes of neighbours and range minima answers
one in constant time, the same over the reversed words answers the other. All grids of a text together
have n ln n places. A query is asked only where the two words agree and, by necessity, one of two further pairs does.

A run found at several periods is that of the least one: by the theorem of Fine and Wilf the others are its multiples. All texts
of a block are worked on at once, with words numbered so that no two texts share a number; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, table, text_or_empty
from .textbytes import blocks, runs, spaced_words, word_spans

#: Words that a run has at least.
SHORTEST = 12
#: Places of grids that are looked at at a time.
GRID_STEP = 1 << 20
#: Neighbours whose minima are found by prefixes and suffixes of a block.
_BLOCK = 16


class RangeMinimum:
    """Minima of any stretches of an array: prefix and suffix minima in blocks, a sparse table over the blocks."""

    def __init__(self, values: np.ndarray):
        n = max(1, -(-len(values) // _BLOCK))
        self.values = np.full(n * _BLOCK, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        grid = self.values.reshape(n, _BLOCK)
        self.front = np.minimum.accumulate(grid, axis=1).ravel()
        self.back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [self.back[::_BLOCK]]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            last, width = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-width], last[width:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of values[low..high], low <= high."""
        a, b = low // _BLOCK, high // _BLOCK
        out = np.minimum(self.back[low], self.front[high])
        far = np.flatnonzero(b - a > 1)
        if len(far):
            first, count = a[far] + 1, b[far] - a[far] - 1
            level = np.frexp(count.astype(np.float64))[1] - 1
            for k in np.unique(level):
                some = level == k
                i = far[some]
                table_, f, c = self.levels[k], first[some], count[some]
                out[i] = np.minimum(out[i], np.minimum(table_[f], table_[f + c - (1 << k)]))
        near = np.flatnonzero(a == b)
        if len(near):
            lo, hi = low[near], high[near]
            least = self.values[lo]
            for step in range(1, int((hi - lo).max()) + 1):
                least = np.minimum(least, self.values[np.minimum(lo + step, hi)])
            out[near] = least
        return out


class Extensions:
    """Longest common prefixes of any two suffixes of a sequence of numbers.

    Prefix doubling: groups of suffixes that agree in k symbols are sorted by the group of the suffix k symbols on. Where
    neighbours part, their common prefix is k and that of the suffixes k on, which parted before. Suffixes that stand alone are left out.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        order = np.argsort(symbols, kind="stable")
        head = runs(symbols[order])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        common = np.full(n, np.iinfo(np.int32).max, np.int32)
        common[head] = 0
        k = 1
        while True:
            # Positions of the order, whole groups, in which more than one suffix stands.
            alone = head & np.append(head[1:], True)
            at = np.flatnonzero(~alone)
            if not len(at):
                break
            group, suffix = rank[order[at]], order[at]
            after = np.where(suffix + k < n, rank[np.minimum(suffix + k, n - 1)], -1)
            by = np.lexsort((after, group))
            suffix, after = suffix[by], after[by]  # groups stay where they are
            order[at] = suffix
            new = np.flatnonzero(runs(group, after) & ~head[at])
            minima = RangeMinimum(common)
            left, right = after[new - 1], after[new]
            value = np.full(len(new), k, np.int32)
            within = np.flatnonzero(left >= 0)
            value[within] += minima.between(left[within] + 1, right[within])
            common[at[new]] = value
            head[at[new]] = True
            # A suffix's rank is the place of its group's head.
            rank[suffix] = np.maximum.accumulate(np.where(head[at], at, 0))
            k *= 2
        self.order, self.rank, self.minima = order, rank, RangeMinimum(common)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols in which the suffixes at i and j, which differ, agree; those at the end of the sequence agree in none."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero((i < self.n) & (j < self.n))
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        out[inside] = self.minima.between(np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def _ragged(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. size - 1 for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def grid_places(words: np.ndarray, limit: int = GRID_STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place): all places jp with (j+1)p in their text too, for all periods up to half the text's words, some at a time.

    ``words`` has the number of words before each text, and in all.
    """
    n = np.diff(words)
    texts = np.flatnonzero(n > 1)
    for low in range(0, len(texts), 256):
        some = texts[low : low + 256]
        periods = n[some] // 2
        first = np.cumsum(periods) - periods
        total, at = int(periods.sum()), 0
        while at < total:
            # So many (text, period) that their places are about ``limit``; the first period has the most places.
            to = min(total, at + limit)
            entry = np.arange(at, to)
            which = np.searchsorted(first, entry, "right") - 1
            p = entry - first[which] + 1
            places = (n[some[which]] - 1) // p
            fit = max(1, int(np.searchsorted(np.cumsum(places), limit, "right")))
            which, p, places = which[:fit], p[:fit], places[:fit]
            text = np.repeat(some[which], places)
            period = np.repeat(p, places)
            yield text, period, words[text] + _ragged(places) * period
            at += fit


def _agree(codes: np.ndarray, i: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the words at i and i + p, both in their text, are the same."""
    inside = (i >= low) & (i + p < high)
    return inside & (codes[np.where(inside, i, 0)] == codes[np.where(inside, i + p, 0)])


def promising_places(codes: np.ndarray, words: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all grid places those that may lie in a run: (text, period, place).

    A run of period p has max(shortest - p, p) pairs of equal words p apart at least, in a row, and the pair at the grid is one of
    them. So half of them follow it or half come before it, and the pair next to it and the pair half as far on are equal too.
    """
    found = []
    for text, p, i in grid_places(words):
        same = codes[i] == codes[i + p]
        text, p, i = text[same], p[same], i[same]
        low, high = words[text], words[text + 1]
        need = np.maximum(shortest - p, p)
        half = need // 2
        on = np.where(need - half > 1, _agree(codes, i + 1, p, low, high), True) & _agree(codes, i + need - half - 1, p, low, high)
        back = _agree(codes, i - 1, p, low, high) & _agree(codes, i - half - 1, p, low, high)
        keep = on | back
        found.append((text[keep], p[keep], i[keep]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(3))


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """Of rows (text, start, length, period) that agree in the first three the one with the least period, in this order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[runs(rows[:, 0], rows[:, 1], rows[:, 2])] if len(rows) else rows


def find_runs(codes: np.ndarray, words: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(text, start, length, period) of all runs, by text, start and period; ``start`` is a word of its text.

    ``codes`` are the words' numbers, equal for equal words, ``words`` as in :func:`grid_places`.
    """
    text, p, i = promising_places(codes, words, shortest)
    if not len(text):
        return np.zeros((0, 4), np.int64)
    # Suffix arrays are built over the texts that have such places, and no two texts share a symbol.
    there = np.unique(text)
    sizes = words[there + 1] - words[there]
    source = np.repeat(words[there], sizes) + _ragged(sizes)
    owner = np.repeat(np.arange(len(there)), sizes)
    symbols = np.unique(owner * (int(codes.max()) + 1) + codes[source], return_inverse=True)[1]
    moved = (np.cumsum(sizes) - sizes - words[there])[np.searchsorted(there, text)]
    i = i + moved
    total = len(symbols)
    forward, backward = Extensions(symbols), Extensions(symbols[::-1].copy())
    out = []
    for at in range(0, len(i), GRID_STEP):
        x, q = i[at : at + GRID_STEP], p[at : at + GRID_STEP]
        ahead = forward.common(x, x + q)
        behind = backward.common(total - x, total - x - q)
        length = ahead + behind + q
        whole = length >= np.maximum(shortest, 2 * q)
        start = x - behind - moved[at : at + GRID_STEP]
        rows = np.stack([text[at : at + GRID_STEP], start, length, q], axis=1)[whole]
        out.append(_least_periods(rows))
    rows = _least_periods(np.concatenate(out))
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    rows[:, 1] -= words[rows[:, 0]]
    return rows


def numbered_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A number for each word, equal for equal words; the number of words before each text; and the words, each with a space behind it."""
    starts, ends, words = word_spans(data, offsets)
    letters, bounds = spaced_words(data, starts, ends)
    spaced = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    codes = spaced.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    return codes, words, spaced


def kept_words(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which words no run holds behind its first period."""
    depth = np.zeros(words[-1] + 1, np.int64)
    start = words[found[:, 0]] + found[:, 1]
    np.add.at(depth, start + found[:, 3], 1)
    np.add.at(depth, start + found[:, 2], -1)
    return np.cumsum(depth[:-1]) <= 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ROWS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _collapse(shortest: int):
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            codes, words, spaced = numbered_words(data, offsets)
            found = find_runs(codes, words, shortest)
            keep = np.flatnonzero(kept_words(words, found))
            left = spaced.take(pa.array(keep)) if len(keep) < len(spaced) else spaced
            _, ends, letters = left.buffers()
            ends = np.frombuffer(ends, np.int64)[left.offset : left.offset + len(left) + 1] if len(left) else np.zeros(1, np.int64)
            # Each text's words stand together; the space behind its last one is left out.
            cut = ends[np.searchsorted(keep, words)]
            raw = b"" if letters is None else memoryview(letters)
            collapsed = [str(raw[a : max(a, b - 1)], "utf-8") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            bounds = np.searchsorted(found[:, 0], np.arange(rows.num_rows + 1))
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in (1, 2, 3)], fields=list(_RUN))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(words)), lists, pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return collapse


def collapse_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Every document's periodic runs, and its words without their repetitions.

    A run is a stretch of words with least period q, of max(shortest, 2q) words at least, that no neighbouring word extends; runs
    may overlap. Returns doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed
    (the words that no run holds behind its first q, joined by one space), one row for each row of ``docs``. Null and empty
    texts have no word and no run. Rows that repeat give rows that repeat, null doc_ids too. An empty table gives no row. Other columns are
    ignored. Nothing is shuffled; a text takes about 200 bytes of memory for each of its words.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_collapse(shortest), _ROWS)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (of equal ones the first, then the one of least period; null without any), its exponent in
    thousandths, and hashes of all runs and of the collapsed text, from :func:`collapse_runs`."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start"),
        (-F.col("longest.l")).alias("length"),
        F.col("longest.period"),
        F.expr("-1000 * longest.l div longest.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document by hash the words from some place on repeat the first ones from there, so that runs of known place are there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    word = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    g, n = F.floor(F.col("h") / 10), F.size("w")
    a = F.col("g") % F.greatest("n", F.lit(1))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    place = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    planted = F.array_join(F.transform(place, lambda i: F.get("w", i.cast("int"))), " ")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, word))
    rows = rows.withColumns({"g": g, "n": n}).withColumn("a", a).withColumn("p", p)
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op13(spark, sf_dir: str) -> DataFrame:
    return run_digests(collapse_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
