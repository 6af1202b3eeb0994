"""Packing of tokenised documents into sequences: Martello-Toth dominance reduction, then best fit.

What is to be packed depends on the lengths alone, so the instance is the number of pieces of each length,
at most ``capacity`` numbers whatever the size of the corpus. On it, small sets of pieces that provably
dominate every alternative are fixed as sequences for good, and best fit decreasing packs what remains;
both work on runs of equal pieces. The result is a list of patterns with how often each is used. Pieces
then find their sequence by their rank among the pieces of their length: a prefix sum over partitions,
so no task holds all pieces of a length.

Documents that come in an order, such as that of a mixture, are packed in windows of it: each window of
WINDOW_ROWS documents is an instance of its own, and sequences are numbered along the order, so what is read
first still holds the mixture.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import checkpointed, prepare, table, text_or_empty
from .textbytes import integers

CAPACITY = 1024
#: Id that ends each document.
END_ID = 2
#: Documents of an order that are packed together.
WINDOW_ROWS = 16_384


class Pattern(NamedTuple):
    """``bins`` sequences that each hold these (length, times), in this order."""

    items: tuple[tuple[int, int], ...]
    bins: int


def reduce_dominated(counts: list[int], capacity: int) -> list[Pattern]:
    """Fix sequences that some optimal packing has, and take their pieces out of ``counts`` (by length, in place).

    For a piece of length a with r left beside it, the pair with the longest fitting k dominates every other
    set that holds a, if k fills r, or if no two pieces fit into r, or if at most two do and no such pair is
    longer than k. A piece beside which nothing fits stands alone.
    """
    fixed = []

    def smallest(n: int, without: int) -> list[int]:
        """The n least lengths left, one piece of ``without`` taken away."""
        out = []
        for size in range(1, capacity + 1):
            out += [size] * min(n - len(out), counts[size] - (size == without))
            if len(out) >= n:
                break
        return out

    def best_pair(r: int, without: int) -> int:
        """Greatest length of two pieces that together fit into r; 0 if none do."""
        best, lo, hi = 0, 1, r - 1
        have = lambda x: counts[x] - (x == without)
        while lo <= hi:
            if have(lo) <= 0:
                lo += 1
            elif have(hi) <= 0 or lo + hi > r or lo == hi and have(lo) < 2:
                hi -= 1
            else:
                best = max(best, lo + hi)
                lo += 1
        return best

    again = True
    while again:
        again = False
        for a in range(capacity, 0, -1):
            while counts[a]:
                r = capacity - a
                least = smallest(3, a)
                if not least or least[0] > r:
                    fixed.append(Pattern(((a, 1),), 1 if r >= a else counts[a]))
                    counts[a] -= fixed[-1].bins
                    again = True
                    continue
                k = next(x for x in range(r, 0, -1) if counts[x] - (x == a) > 0)
                if k < r and len(least) > 1 and least[0] + least[1] <= r:
                    if len(least) > 2 and sum(least) <= r or best_pair(r, a) > k:
                        break
                bins = counts[a] // 2 if k == a else min(counts[a], counts[k])
                fixed.append(Pattern(((a, 2),) if k == a else ((a, 1), (k, 1)), bins))
                counts[a] -= bins
                counts[k] -= bins
                again = True
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best fit decreasing: longest pieces first, each into the fullest sequence that still takes it."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(left: int, items: tuple, bins: int) -> None:
        if bins:
            open_.setdefault(left, []).append((items, bins))

    for a in range(capacity, 0, -1):
        c = counts[a]
        while c:
            left = min((r for r, held in open_.items() if r >= a and held), default=capacity)
            items, bins = open_[left].pop() if open_.get(left) else ((), c)
            fit = left // a
            full = min(bins, c // fit)
            put(left - fit * a, (*items, (a, fit)), full)
            c -= full * fit
            if full < bins and 0 < c < fit:
                put(left - c * a, (*items, (a, c)), 1)
                c, full = 0, full + 1
            if items:
                put(left, items, bins - full)
    return [Pattern(items, bins) for held in open_.values() for items, bins in held]


def pack_lengths(counts: list[int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every piece; ``counts[n]`` is the number of pieces of length n."""
    counts = list(counts)
    return reduce_dominated(counts, capacity) + best_fit(counts, capacity)


class Places:
    """Sequence and offset of each piece, by its length and its rank among the pieces of this length."""

    def __init__(self, patterns: list[Pattern]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for items, bins in patterns:
            offset = 0
            for size, times in items:
                rows.setdefault(size, []).append((taken.get(size, 0), first, times, offset))
                taken[size] = taken.get(size, 0) + bins * times
                offset += size * times
            first += bins
        self.rows = {size: np.array(x, np.int64).T for size, x in rows.items()}
        self.sequences = first

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for size in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == size)
            starts, first, times, base = self.rows[size]
            k = np.searchsorted(starts, ranks[at], "right") - 1
            i = ranks[at] - starts[k]
            sequence[at] = first[k] + i // times[k]
            offset[at] = base[k] + i % times[k] * size
        return sequence, offset


def encoder(path: str):
    """The byte-level BPE of a ``tokenizers`` file, whole texts to ids, added tokens read as ordinary text.

    The file's ids ascend with its merges, so they serve as the ranks by which tiktoken applies the same
    merges in a third of the time.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # Each character of a piece stands for one byte: a printable byte for itself, the others from 256 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*printable}))}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in piece): k for piece, k in tokenizer.get_vocab().items() if piece not in special}
    return tiktoken.Encoding("ranks of the file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Whitespace in a row that tiktoken is given; its expression runs out of stack between 300,000 and 1,000,000.
LONGEST_RUN = 10_000
_LONG_RUN = re.compile(r"\s{100,}")


def file_ids(path: str):
    """A function that gives a text's ids as the ``tokenizers`` file says, without its post-processor.

    The file's added tokens are cut out first, the longest at each place; the text between them goes to
    :func:`encoder`, or whole to ``tokenizers`` itself where whitespace runs on too long or a token takes its surroundings in.
    """
    from tokenizers import Tokenizer

    plain, tokenizer = encoder(path).encode_ordinary, Tokenizer.from_file(path)
    tokens = tokenizer.get_added_tokens_decoder()
    added = {t.content: k for k, t in tokens.items()}
    bare = not any(t.single_word or t.lstrip or t.rstrip for t in tokens.values())
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def ids(text: str) -> list[int]:
        holds = any(content in text for content in added)
        if holds and not bare or len(text) > LONGEST_RUN and any(m.end() - m.start() > LONGEST_RUN for m in _LONG_RUN.finditer(text)):
            return tokenizer.encode(text, add_special_tokens=False).ids
        if not holds:
            return plain(text)
        # Every other part is an added token.
        return [k for at, part in enumerate(cut.split(text)) for k in ([added[part]] if at % 2 else plain(part))]

    return ids


_encoders: dict[str, object] = {}

#: Rows of pieces that are returned at a time, about.
_STEP = 4096

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int, rank long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of the tokenised texts, each with its rank among the pieces of its length in its partition (``bucket``).

    A document is its ids and END_ID. One longer than ``capacity`` is cut so that all but its first piece are
    full. Null texts are empty, rows that repeat others give pieces of their own. ``keep`` names columns of
    whole numbers that each piece takes along from its row.
    """
    prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = file_ids(tokenizer_path)
        encode, bucket = _encoders[tokenizer_path], TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.array([END_ID], "<u4").tobytes()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * len(keep)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bucket", "rank", *keep]
        for rows in batches:
            texts, out = rows.column(1), []
            kept = [c.to_pylist() for c in rows.columns[2:]]
            for at, name in enumerate(rows.column(0).to_pylist()):
                ids = np.array(encode(texts[at].as_py()), "<u4").tobytes() + end
                n = len(ids) // 4
                start, to = 0, n - (n - 1) // capacity * capacity
                for piece in range((n - 1) // capacity + 1):
                    out.append((name, piece, start, to - start, zlib.crc32(ids[4 * start : 4 * to]), bucket, seen[to - start], *[c[at] for c in kept]))
                    seen[to - start] += 1
                    start, to = to, to + capacity
                if len(out) >= _STEP or out and at == rows.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []

    schema = ", ".join([_PIECES, *[f"{c} long" for c in keep]])
    return docs.select("doc_id", text_or_empty().alias("text"), *keep).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with the sequence and the offset where each stands.

    Returns doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset. Null texts are empty and
    consist of END_ID alone. Rows that repeat a doc_id are packed each for itself. An empty table gives no
    row. Other columns of ``docs`` are ignored.
    """
    pieces = checkpointed(token_pieces(docs, tokenizer_path, capacity))
    own = pieces.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = own.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = [0] * (capacity + 1)
    for row in own.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    # A pattern uses up a length or the open sequences of another pattern, so there are about as many as lengths: 1,300 of
    # capacity 1024 for 10**4 pieces and for 10**11.
    places = docs.sparkSession.sparkContext.broadcast(Places(pack_lengths(counts, capacity)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sequence, offset = places.value.find(integers(rows, "length"), integers(rows, "rank") + integers(rows, "base"))
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["bucket", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "base")
    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence long, offset long"


def _pack_window(capacity: int):
    def pack_rows(window: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "piece"], kind="stable")
        lengths = rows["length"].to_numpy()
        ranks = rows.groupby("length", sort=False).cumcount().to_numpy()
        sequence, offset = Places(pack_lengths(np.bincount(lengths, minlength=capacity + 1).tolist(), capacity)).find(lengths, ranks)
        # Sequences follow the order of their first documents.
        _, first, number = np.unique(sequence, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        return pd.concat([pd.Series([window[0]] * len(rows), rows.index, name="window"), rows[["doc_id", "piece", "start", "length", "ids_crc32"]]], axis=1).assign(sequence=rank[number], offset=offset)

    return pack_rows


def pack_in_order(docs: DataFrame, tokenizer_path: str, order: tuple[Column, Column], capacity: int = CAPACITY, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """As :func:`pack`, in windows of ``window_rows`` documents of an order; sequence_id counts from 0 along it.

    ``order`` is a number of a file (or another part) and the row's place in it, from 0, no two rows at one place.
    """
    rows = docs.select(docs["doc_id"], docs["text"], order[0].alias("part"), order[1].alias("at"))
    # A row for each file.
    line = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg((F.max("at") + 1).alias("n"))
    bases = parts.select("part", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("base"))
    pieces = token_pieces(rows, tokenizer_path, capacity, ("part", "at")).join(bases, "part").withColumn("at", F.col("at") + F.col("base"))
    pieces = pieces.select(F.expr(f"at div {window_rows}").alias("window"), "at", "doc_id", "piece", "start", "length", "ids_crc32")
    placed = checkpointed(pieces.groupBy("window").applyInPandas(_pack_window(capacity), f"window long, {_PLACED}"))
    windows = placed.groupBy("window").agg((F.max("sequence") + 1).alias("n"))
    line = Window.partitionBy(F.lit(0)).orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    firsts = windows.select("window", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("first"))
    return placed.join(firsts, "window").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset")


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
