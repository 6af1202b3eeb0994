"""Ogg media columns: store payloads in Ogg containers and read them back.

A payload is stored as 8-bit samples. Its packets of PACKET_BYTES are dealt to STREAMS logical streams
in turn, each with a header packet on its first page, and pages of the streams are interleaved. Reading
verifies each page's checksum, reassembles packets from lacing values over page borders, demultiplexes
the streams by serial number, derives the time of each packet from granule positions and puts the
packets into order by these times.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, table, text_or_empty
from .textbytes import blocks

#: A payload is padded with zero bytes to a positive multiple of this.
PAD = 64
STREAMS, PACKET_BYTES, SAMPLE_RATE = 2, 4096, 8000
#: Lacing values of a page; 255 at most in the format.
PAGE_SEGMENTS = 255

# Fixed values of the Ogg format: capture pattern, page header, and its flags.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

#: Own header packet: magic, version, stream number, number of streams, sample rate, samples of a packet.
CODEC = struct.Struct("<8sBBHII")
MAGIC = b"PCM8\0\0\0\0"

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, first bit highest, no inversion: zlib's CRC of mirrored bytes, mirrored."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", ogg_checksum(head + body)) + head[26:] + body


def _pages(stream: int, packets: list[tuple[bytes, int]], segments: int) -> list[bytes]:
    """Pages of one logical stream; packets come with the granule position (samples so far) at their end."""
    lacing = [bytes([255]) * (len(p) // 255) + bytes([len(p) % 255]) for p, _ in packets]
    pages, at, open_ = [], 0, False
    values, body = b"".join(lacing), b"".join(p for p, _ in packets)
    ends = np.cumsum([len(x) for x in lacing])
    head = len(lacing[0])
    cuts = [head, *range(head + segments, len(values), segments), len(values)] if len(values) > head else [head]
    used = 0
    for k, to in enumerate(cuts):
        part = values[at:to]
        size = sum(part)
        done = int(np.searchsorted(ends, to, "right"))
        finished = done > 0 and ends[done - 1] > at
        flags = CONTINUED * open_ | FIRST * (k == 0) | LAST * (k == len(cuts) - 1)
        pages.append(_page(flags, packets[done - 1][1] if finished else -1, stream + 1, k, part, body[used : used + size]))
        at, used, open_ = to, used + size, part[-1] == 255
    return pages


def encode(payload: bytes, streams: int = STREAMS, packet_bytes: int = PACKET_BYTES, rate: int = SAMPLE_RATE, segments: int = PAGE_SEGMENTS) -> bytes:
    """An Ogg file of ``streams`` logical streams that holds the payload's bytes as samples."""
    parts = [payload[at : at + packet_bytes] for at in range(0, len(payload), packet_bytes)]
    pages = []
    for s in range(streams):
        packets = [(CODEC.pack(MAGIC, 1, s, streams, rate, packet_bytes), 0)]
        for k in range(s, len(parts), streams):
            packets.append((parts[k], k * packet_bytes + len(parts[k])))
        pages.append(_pages(s, packets, segments))
    firsts = [p[0] for p in pages]
    rest = [p[k] for k in range(1, max(map(len, pages))) for p in pages if k < len(p)]
    return b"".join(firsts + rest)


class Damaged(ValueError):
    """The bytes aren't an Ogg file whose pages and packets are whole."""


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream by serial number, with the granule position of the page where they end (-1: none)."""
    packets: dict[int, list[tuple[bytes, int]]] = {}
    partial: dict[int, bytes] = {}
    sequence: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(media):
        if len(media) < at + HEADER.size:
            raise Damaged("cut page header")
        capture, version, flags, granule, serial, number, checksum, n = HEADER.unpack_from(media, at)
        body = at + HEADER.size + n
        lacing = media[at + HEADER.size : body]
        to = body + sum(lacing)
        if capture != CAPTURE or version or len(lacing) < n or len(media) < to:
            raise Damaged("no whole page")
        page = media[at:to]
        if ogg_checksum(page[:22] + bytes(4) + page[26:]) != checksum:
            raise Damaged("page checksum")
        if bool(flags & FIRST) != (serial not in packets) or number != sequence.get(serial, 0) or serial in ended:
            raise Damaged("page sequence")
        if bool(flags & CONTINUED) != (serial in partial):
            raise Damaged("continued packet")
        sequence[serial] = number + 1
        out, held = packets.setdefault(serial, []), partial.pop(serial, None)
        # A value below 255 ends a packet; values of 255 at the page's end leave it open.
        start = body
        size = len(held or b"")
        for value in lacing:
            size += value
            if value < 255:
                end = start + size - len(held or b"")
                out.append(((held or b"") + media[start:end], granule))
                start, held, size = end, None, 0
        if lacing and lacing[-1] == 255:
            partial[serial] = (held or b"") + media[start:to]
        if flags & LAST:
            ended.add(serial)
        at = to
    if partial or not packets or ended != set(packets):
        raise Damaged("stream without an end")
    return packets


def decode(media: bytes) -> tuple[bytes, list[tuple[int, int, int]], int]:
    """Payload, (start sample, samples, stream) of each packet in order, and the sample rate.

    A page's granule position is the time at the end of its last packet; the packets before it on the page
    are dated back from there, a stream's own step between packets being known from its header.
    """
    found: list[tuple[int, bytes, int]] = []
    rate, seen = 0, {}
    logical = demultiplex(media)
    for packets in logical.values():
        if len(packets[0][0]) != CODEC.size:
            raise Damaged("codec header")
        magic, version, stream, streams, rate, step = CODEC.unpack(packets[0][0])
        # Streams are numbered once each and agree in what they share; no rate and no step is zero.
        if magic != MAGIC or version != 1 or not rate or not step or stream >= streams or streams != len(logical) or stream in seen:
            raise Damaged("codec header")
        seen[stream] = (streams, rate, step)
        if len(set(seen.values())) > 1:
            raise Damaged("codec headers contradict each other")
        k = 1
        while k < len(packets):
            last = k
            while last + 1 < len(packets) and packets[last + 1][1] == packets[k][1]:
                last += 1
            end = packets[last][1] - len(packets[last][0])
            for j in range(k, last + 1):
                found.append((end - (last - j) * step * streams, packets[j][0], stream))
            k = last + 1
    found.sort(key=lambda x: x[0])
    return b"".join(p for _, p, _ in found), [(t, len(p), s) for t, p, s in found], rate


def feature(payload: bytes, packets: list[tuple[int, int, int]], rate: int) -> str:
    """Streams, packets, duration and last packet's time in ms, mean sample, sum of absolute steps and silent samples."""
    x = np.frombuffer(payload, np.uint8)
    rough = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return ";".join(
        f"{k}={v}"
        for k, v in {
            "streams": len({s for _, _, s in packets}),
            "packets": len(packets),
            "ms": len(payload) * 1000 // rate,
            "last_ms": packets[-1][0] * 1000 // rate,
            "sum": int(x.sum(dtype=np.int64)),
            "steps": rough,
            "silent": int(np.count_nonzero(x == 0)),
        }.items()
    )


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in blocks(batches, limit=8 << 20):
        raw = data.tobytes()
        media, sizes = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            n = max(PAD, -(-(b - a) // PAD) * PAD)
            media.append(encode(raw[a:b].ljust(n, b"\0")))
            sizes.append(b - a)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the Ogg file of each whole text's padded UTF-8 bytes; null texts are empty."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for rows, data, offsets in blocks(batches, "media", 8 << 20):
        raw, out = data.tobytes(), []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            media = raw[a:b]
            stored = (len(media), hashlib.sha256(media).hexdigest())
            try:
                payload, packets, rate = decode(media)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), *stored, feature(payload, packets, rate), None))
            except (Damaged, struct.error, IndexError) as e:
                out.append((None, None, None, *stored, None, str(e) or "not whole"))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], ["doc_id", "n_bytes", *names])


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of each stored file, from its bytes alone; ``error`` says what is damaged, the rest is then null.

    Equal files give equal values. Null or empty media are damaged. Other columns are ignored.
    """
    prepare(media.sparkSession)
    return media.select("doc_id", "n_bytes", F.coalesce("media", F.lit(b"")).alias("media")).mapInArrow(_decoded, _READ)


def op10(spark, sf_dir: str) -> DataFrame:
    return read_media(to_media(table(spark, sf_dir, "documents"))).drop("error")
