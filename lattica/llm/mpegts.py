"""Media columns: MPEG transport streams.

A payload is cut into access units of ``UNIT`` bytes. Each becomes a packetised
elementary stream packet with a presentation timestamp, carried by 188-byte
transport packets with a continuity counter; every ``GOP``-th unit is marked as a
random-access point. A program association and a program map table come first.

Reading parses the tables (with their CRC), picks the program's packets by PID,
checks sync bytes and continuity counters, reassembles the elementary packets and
stores their timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches

FRAME = 576
UNIT = 16 * FRAME
GOP = 4
TICKS = 3600  # of 90 kHz: 25 units a second
PAT_PID, PMT_PID, ES_PID, STREAM_TYPE = 0, 0x100, 0x101, 0x06
PACKET, SYNC = 188, 0x47


@lru_cache(maxsize=64)
def crc_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    inner = number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section = bytes([table_id]) + (0xB000 | len(inner) + 4).to_bytes(2, "big") + inner
    section += crc_mpeg(section).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def tables() -> bytes:
    pat = _table(PAT_PID, 0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _table(PMT_PID, 2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    return pat + pmt


def _pts(ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 255, 1 | ticks >> 14 & 0xFE, ticks >> 7 & 255, 1 | ticks << 1 & 0xFE])


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes, unit: int = UNIT, gop: int = GOP) -> bytes:
    """The transport stream of a payload; units of up to 65,000 bytes. An empty payload has tables alone."""
    parts, counter = [tables()], 0
    for i, at in enumerate(range(0, len(payload), unit)):
        own = payload[at : at + unit]
        pes = b"\x00\x00\x01\xbd" + (len(own) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(i * TICKS) + own
        # The first packet has an adaptation field with flags; the last one is filled up by stuffing.
        first, rest = pes[:182], pes[182:]
        whole = len(rest) // 184
        tail = rest[whole * 184 :]
        n = 1 + whole + bool(tail)
        out = np.full((n, PACKET), 255, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        out[0, 1] |= 0x40
        out[0, 3] |= 0x20
        out[0, 4], out[0, 5] = PACKET - 5 - len(first), 0x40 * (i % gop == 0)
        out[0, PACKET - len(first) :] = np.frombuffer(first, np.uint8)
        if whole:
            out[1 : 1 + whole, 4:] = np.frombuffer(rest, np.uint8, whole * 184).reshape(whole, 184)
        if tail:
            out[-1, 3] |= 0x20
            out[-1, 4] = PACKET - 5 - len(tail)
            if len(tail) < 183:
                out[-1, 5] = 0
            out[-1, PACKET - len(tail) :] = np.frombuffer(tail, np.uint8)
        counter = (counter + n) & 15
        parts.append(out.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    errors: int = 0
    timestamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)

    def feature(self) -> str:
        duration = self.timestamps[-1] - self.timestamps[0] if self.timestamps else 0
        return f"packets={self.packets};units={len(self.timestamps)};random_access={len(self.random_access)};ticks={duration};errors={self.errors}"


def _section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet[5 + int(packet[4]) :].tobytes()
    size = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
    if raw[0] != table_id or crc_mpeg(raw[: size - 4]) != int.from_bytes(raw[size - 4 : size], "big"):
        raise ValueError("damaged program table")
    return raw[8 : size - 4]


def demux(stream: bytes) -> Stream:
    """Reads a transport stream; ``errors`` counts lost sync bytes and breaks of continuity."""
    out = Stream(packets=len(stream) // PACKET)
    p = np.frombuffer(stream, np.uint8, out.packets * PACKET).reshape(-1, PACKET)
    out.errors = int((p[:, 0] != SYNC).sum())
    pid = (p[:, 1].astype(np.uint16) & 31) << 8 | p[:, 2]
    pat = _section(p[pid == PAT_PID][0], 0)
    pmt = _section(p[pid == (int.from_bytes(pat[2:4], "big") & 0x1FFF)][0], 2)
    es = p[pid == (int.from_bytes(pmt[5:7], "big") & 0x1FFF)]
    if not len(es):
        return out
    counters = es[:, 3] & 15
    out.errors += int((np.diff(counters) & 15 != 1).sum())
    adapted = es[:, 3] & 0x20 != 0
    skip = np.where(adapted, 5 + es[:, 4].astype(np.int64), 4)
    starts = np.flatnonzero(es[:, 1] & 0x40)
    bounds = [*starts.tolist(), len(es)]
    place = np.arange(PACKET)
    bodies = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        pes = es[a:b][place >= skip[a:b, None]].tobytes()
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or size != len(pes) - 6:
            raise ValueError("damaged elementary packet")
        out.timestamps.append(_ticks(pes[9:14]))
        if adapted[a] and es[a, 4] and es[a, 5] & 0x40:
            out.random_access.append(len(out.timestamps) - 1)
        bodies.append(pes[9 + pes[8] :])
    out.payload = b"".join(bodies)
    return out


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, random_access array<long>, timestamps array<long>, media binary"


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """MEDIA per document: its text's bytes, padded by 255 to a positive multiple of FRAME, as a transport stream read back.

    A null text is empty and so FRAME bytes of padding. ``media`` holds the stream if
    ``keep_media`` is set; ``timestamps`` are those of its elementary packets in ticks,
    ``random_access`` the numbers of the packets that can be started from. A long text
    is one stream. Repeated rows give repeated results; further columns are ignored; no
    rows give no rows.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        names = [x.split()[0] for x in MEDIA.split(", ")]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                media = mux(data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data)))
                got = demux(media)
                rows.append((
                    doc, len(data), len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-32:]), len(media),
                    hashlib.sha256(media).hexdigest(), got.feature(), got.random_access, got.timestamps, media if keep_media else None,
                ))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(convert, MEDIA)
