"""Conversations as token sequences with a loss mask, assembled from tokens.

Every segment, a role's name or a turn's text, is encoded by itself, and the marks of the template are spliced in between as
reserved ids above the vocabulary, so no text can ever yield one. In the formatted text the marks are strings. Where a text holds
such a string, one ESCAPE goes behind its first letter, and one more where some are there already; taking one away
restores the text. Prefix sums of the segments' sizes give the places of the marks and of the mask.

    user            [INST]text[/INST]
    assistant       text</s>
    other roles     [ROLE]name[/ROLE]text</s>

The assistants' texts and the marks that end them are under the loss mask.

Turns are dealt by ranges of (conversation, turn), so a conversation that holds a third of all turns is formatted by many tasks. It is then
a row of its own for each of them, as is one of more than PART_TOKENS tokens: the parts of a conversation follow each other by number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import LONGEST_RUN, encoder
from .runtime import checkpointed, prepare, table

# The marks of the template; their ids follow the vocabulary in this order.
MARKS = ("</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
END, USER, USER_END, ROLE, ROLE_END = range(5)
ESCAPE = "\\"
#: Tokens from which a part is closed, and tokens of a conversation that are held until it is known to be whole.
PART_TOKENS, HELD_TOKENS = 1 << 16, 1 << 20

# The first letter of a mark that may have escapes behind it, and the first of these. First letters occur nowhere else in marks, so
# marks never overlap.
_FIRST = re.compile(r"<(?=\\*/s>)|\[(?=\\*/?(?:INST|ROLE)\])")
_ESCAPED = re.compile(r"(?<=<)\\(?=\\*/s>)|(?<=\[)\\(?=\\*/?(?:INST|ROLE)\])")
_BLANKS = re.compile(r"\s{100,}")


def escaped(text: str) -> str:
    """The text without any mark; :func:`unescaped` restores it."""
    return _FIRST.sub(lambda m: m[0] + ESCAPE, text) if "<" in text or "[" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub("", text) if ESCAPE in text else text


class Codec:
    """Ids of ordinary text by a tokenizer's file, and back; reserved ids begin at ``base``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain, self.tokenizer = encoder(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def ids(self, text: str) -> list[int]:
        if len(text) > LONGEST_RUN and any(m.end() - m.start() > LONGEST_RUN for m in _BLANKS.finditer(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)

    def text(self, ids: np.ndarray) -> str:
        """The text of ids of which none is reserved."""
        return self.plain.decode_bytes(ids.tolist()).decode("utf-8")


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def assembled(codec: Codec, role: str, text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Ids of one turn, and the spans (start, end) of them that are under the loss mask."""
    body = codec.ids(escaped(text))
    if role == "user":
        segments, loss = [[codec.base + USER], body, [codec.base + USER_END]], []
    elif role == "assistant":
        segments, loss = [body, [codec.base + END]], [0, 1]
    else:
        segments, loss = [[codec.base + ROLE], codec.ids(escaped(role)), [codec.base + ROLE_END], body, [codec.base + END]], []
    ends = np.cumsum([0, *map(len, segments)])
    return np.concatenate([np.array(s, np.int32) for s in segments]), [(int(ends[loss[0]]), int(ends[loss[-1] + 1]))] if loss else []


class Turn(NamedTuple):
    role: str
    text: str


def read_turns(codec: Codec, ids: np.ndarray) -> Iterator[Turn]:
    """The turns of a part, from its ids alone."""
    marks = np.flatnonzero(ids >= codec.base)
    at, k = 0, 0

    def text(to: int) -> str:
        return unescaped(codec.text(ids[at:to]))

    while k < len(marks):
        mark = int(ids[marks[k]]) - codec.base
        if mark == END:
            yield Turn("assistant", text(marks[k]))
            k += 1
        elif mark == USER:
            at = int(marks[k]) + 1
            yield Turn("user", text(marks[k + 1]))
            k += 2
        else:
            at = int(marks[k]) + 1
            role = text(marks[k + 1])
            at = int(marks[k + 1]) + 1
            yield Turn(role, text(marks[k + 2]))
            k += 3
        at = int(marks[k - 1]) + 1


def loss_texts(codec: Codec, ids: np.ndarray, spans: np.ndarray) -> Iterator[str]:
    """The texts under the loss mask, marks left out."""
    for start, end in spans.tolist():
        part = ids[start:end]
        yield unescaped(codec.text(part[part < codec.base]))


def formatted_text(codec: Codec, ids: np.ndarray) -> str:
    """The whole formatted text of a part, marks as strings."""
    out, at = [], 0
    for k in np.flatnonzero(ids >= codec.base).tolist():
        out += [codec.text(ids[at:k]), MARKS[int(ids[k]) - codec.base]]
        at = k + 1
    return "".join(out) + codec.text(ids[at:])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_PARTS = "conv_id long, part long, n_turns int, ids array<int>, loss array<struct<start:int,end:int>>"
_NAMES = ["conv_id", "part", "n_turns", "ids", "loss"]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays)))


def _format(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, first = _codec(path), TaskContext.get().partitionId() << 32
        done: list[tuple] = []
        conv, turns, ids, spans, size, number, held = None, 0, [], [], 0, 0, 0

        def close() -> None:
            nonlocal turns, ids, spans, size, number
            if turns:
                done.append((conv, first + number, turns, np.concatenate(ids), spans))
                turns, ids, spans, size, number = 0, [], [], 0, number + 1

        def batch() -> pa.RecordBatch:
            conv_ids, parts, counts, tokens, loss = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(conv_ids, pa.int64()), pa.array(parts), pa.array(counts, pa.int32()), _lists(list(tokens)), pa.array([[{"start": a, "end": b} for a, b in s] for s in loss], _SPANS)], _NAMES)

        for rows in batches:
            for own, role, text in zip(*(rows.column(k).to_pylist() for k in range(3))):
                if own != conv or size >= PART_TOKENS:
                    close()
                    conv = own
                    if held >= 16 * PART_TOKENS:
                        yield batch()
                        held = 0
                more, loss = assembled(codec, role, text)
                spans += [(a + size, b + size) for a, b in loss]
                ids.append(more)
                size, held, turns = size + len(more), held + len(more), turns + 1
        close()
        if done:
            yield batch()

    return run


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token sequences of conversations(conv_id, turn, role, text): (conv_id, part, n_turns, ids, loss).

    ``ids`` has the part's tokens, ``loss`` the spans of them, from start to before end, under the loss mask. Turns follow each other by
    turn, null first; of equal ones by a hash of role and text. A conversation is one row, or several that follow each other by
    ``part`` where it lies in two tasks' ranges or has more than PART_TOKENS tokens; no turn is divided. Null text and role are empty, rows
    that repeat are turns of their own, a null conv_id is a conversation. An empty table gives no row. Other columns are ignored.
    """
    prepare(conversations.sparkSession)
    turns = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    keys = ["conv_id", "turn", F.xxhash64("role", "text")]
    ordered = turns.repartitionByRange(*keys).sortWithinPartitions(*keys, "role", "text")
    return ordered.mapInArrow(_format(tokenizer_path), _PARTS)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_FOLDED = f"{_DIGESTS}, part long, ids array<int>, loss array<struct<start:int,end:int>>"


class _Digest:
    """What is read back from the parts of one conversation, in their order."""

    def __init__(self, codec: Codec):
        self.codec, self.turns, self.loss = codec, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, ids: np.ndarray, spans: np.ndarray) -> None:
        for turn in read_turns(self.codec, ids):
            self.turns.update(f"{turn.role}\n{turn.text}\n".encode())
            self.n_turns += 1
        for text in loss_texts(self.codec, ids, spans):
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted_text(self.codec, ids))

    def row(self, conv: int | None) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _fold(path: str, whole: bool):
    """Digests of conversations, from parts in order. Unless all of a conversation's parts are known to be here (``whole``), those of a
    task's first and last one, and of one that is too long to be held, are passed on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        conv, digest, begun = None, None, False
        held: list[pa.RecordBatch] = []
        size, out = 0, []

        def folded(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.int32())), pa.nulls(len(rows), _SPANS)], [f.split()[0] for f in _DIGESTS.split(", ")] + ["part", "ids", "loss"])

        def passed(row: pa.RecordBatch) -> pa.RecordBatch:
            n = row.num_rows
            empty = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())]
            return pa.RecordBatch.from_arrays([row.column(0), *empty, row.column(1), row.column(2), row.column(3).cast(_SPANS)], [f.split()[0] for f in _DIGESTS.split(", ")] + ["part", "ids", "loss"])

        for rows in batches:
            names = rows.column(0).to_pylist()
            for at, own in enumerate(names):
                if not begun or own != conv:
                    if begun and digest is not None:
                        out.append(digest.row(conv))
                        if len(out) >= 4096:
                            yield folded(out)
                            out = []
                    digest = _Digest(codec) if whole or begun else None
                    conv, begun, held, size = own, True, [], 0
                row = rows.slice(at, 1)
                if digest is None:
                    yield passed(row)
                    continue
                ids = row.column(2).flatten().to_numpy(zero_copy_only=False)
                spans = row.column(3).flatten()
                pairs = np.stack([spans.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1) if len(spans) else np.zeros((0, 2), np.int32)
                if not whole:
                    held.append(row)
                    size += len(ids)
                    if size > HELD_TOKENS:
                        yield from map(passed, held)
                        held, digest = [], None
                        continue
                digest.add(ids, pairs)
        if digest is not None and whole:
            out.append(digest.row(conv))
        if out:
            yield folded(out)
        if not whole:
            yield from map(passed, held)

    return run


def read_back(parts: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of each conversation, from what :func:`format_conversations` returns and nothing else.

    Returns conv_id, n_turns, turns_sha256 (of role, line end, text, line end for each turn), loss_chars and loss_sha256 (of the
    unescaped text under the loss mask) and formatted_chars (characters with marks and escapes). Nearly all conversations are
    read where they are. Only those that may lie in two tasks, and very long ones, are gathered, and read part by part: SHA-256
    of a conversation has to see it from its beginning to its end, so it is one task's work, of bounded memory.
    """
    prepare(parts.sparkSession)
    columns = ("conv_id", "part", "ids", "loss")
    folded = checkpointed(parts.select(*columns).mapInArrow(_fold(tokenizer_path, False), _FOLDED))
    names = [f.split()[0] for f in _DIGESTS.split(", ")]
    here = folded.where("part IS NULL").select(*names)
    gathered = folded.where("part IS NOT NULL").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return here.union(gathered.mapInArrow(_fold(tokenizer_path, True), _FOLDED).select(*names))


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) and conversation -1, of two turns that are made of marks."""
    text = f"{MARKS[END]}{MARKS[USER]} ok {MARKS[USER_END]}"
    own = conversations.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(own)


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_back(format_conversations(with_control_strings(table(spark, sf_dir, "conversations")), path), path)


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*/s>)', '<\\\1', 'g'), '\[(\\*/?(INST|ROLE)\])', '[\\\1', 'g'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4
      ELSE length(regexp_replace(regexp_replace(role, '<(\\*/s>)', '<\\\1', 'g'), '\[(\\*/?(INST|ROLE)\])', '[\\\1', 'g')) + 17 END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
