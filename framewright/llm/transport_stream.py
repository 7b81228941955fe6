"""Operator 10: media columns as MPEG transport streams.

A payload is cut into access units of 192 bytes (8-bit samples), carried as private data: packetised elementary packets of up to 64 units with presentation times
of a 90 kHz clock, in 188-byte transport packets with continuity counters, a program association table and a program map table with CRCs, a program clock reference and the random-access flag at the
start of every elementary packet. The reader assembles the tables from as many packets as they take, follows one elementary stream (the first of the first program, unless another is named), checks continuity counters,
reassembles the elementary packets and returns timestamps and random-access points. It takes what the standard allows: packets without payload, a repeated packet, an announced discontinuity, elementary packets of open length, streams
without times or clock, several programs and streams (which it lists).

A null text is an empty one; its payload is 192 blanks. Equal texts give equal streams. Streams with a missing sync byte, a transport error, scrambling, a wrong table CRC, a gap in the counters or a truncated
elementary packet are refused: ``demux`` raises, and the column's reader gives that row the reason as its status and nulls for its features, without touching other rows. Null media is such a row too. Texts of any length are carried whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import documents, map_text, materialize

PACKET, UNIT, UNITS_PER_PES = 188, 192, 64
PMT_PID, STREAM_PID, PROGRAM = 0x100, 0x101, 1
PRIVATE_STREAM, STREAM_ID = 0x06, 0xBD
CLOCK, UNIT_TICKS, FIRST_TIME = 90_000, 360, 90_000  # 192 samples at 48 kHz last 4 ms
# Stream ids whose packets have no header after the length.
PLAIN_STREAMS = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def section_packets(pid: int, table_id: int, extension: int, body: bytes) -> bytes:
    """A table's section in as many packets as it takes."""
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), extension, 0xC1, 0, 0)
    section = head + body
    data, out = b"\0" + section + struct.pack(">I", section_crc(section)), []
    for counter, at in enumerate(range(0, len(data), PACKET - 4)):
        part = data[at : at + PACKET - 4]
        out.append(struct.pack(">BHB", 0x47, (0 if at else 0x4000) | pid, 0x10 | counter % 16) + part + b"\xff" * (PACKET - 4 - len(part)))
    return b"".join(out)


_PAT = section_packets(0, 0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = section_packets(PMT_PID, 0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_STREAM, 0xE000 | STREAM_PID, 0xF000))


def _time_bytes(ticks: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (ticks >> 29) & 0x0E, (ticks >> 14) & 0xFFFE | 1, (ticks << 1) & 0xFFFE | 1)


def _time_of(data: bytes) -> int:
    a, b, c = struct.unpack(">BHH", data[:5])
    return ((a & 0x0E) << 29) | ((b & 0xFFFE) << 14) | (c >> 1)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes, padded by blanks to a positive multiple of the unit, and the number of bytes before."""
    data = (text or "").encode()
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def mux(payload: bytes) -> bytes:
    """A transport stream that carries the payload, a multiple of UNIT bytes."""
    out, counter, step = [_PAT, _PMT], 0, UNIT * UNITS_PER_PES
    for k, at in enumerate(range(0, len(payload), step)):
        part = payload[at : at + step]
        time = (FIRST_TIME + k * UNITS_PER_PES * UNIT_TICKS) & ((1 << 33) - 1)
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(part) + 8, 0x84, 0x80, 5) + _time_bytes(time) + part
        # the first packet has an adaptation field with the random-access flag and the clock; the last is stuffed
        clock = struct.pack(">BBIH", 7, 0x50, (time >> 1) & 0xFFFFFFFF, (time & 1) << 15 | 0x7E00)
        room = PACKET - 4 - len(clock)
        first = pes[:room]
        if len(first) < room:
            clock = bytes([7 + room - len(first)]) + clock[1:] + b"\xff" * (room - len(first))
        out.append(struct.pack(">BHB", 0x47, 0x4000 | STREAM_PID, 0x30 | counter) + clock + first)
        rest = pes[room:]
        whole, tail = divmod(len(rest), PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + 1 + np.arange(whole)) % 16
            packets[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, -1)
            out.append(packets.tobytes())
        counter = (counter + 1 + whole) % 16
        if tail:
            spare = PACKET - 4 - tail
            stuffing = bytes([spare - 1]) + (b"\0" + b"\xff" * (spare - 2) if spare > 1 else b"")
            out.append(struct.pack(">BHB", 0x47, STREAM_PID, 0x30 | counter) + stuffing + rest[whole * (PACKET - 4) :])
            counter = (counter + 1) % 16
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    stream_type: int
    packets: int
    times: list[int]
    random_access: list[int]  # numbers of the transport packets
    clocks: list[int]
    programs: dict[int, dict[int, int]]  # of each program, the type of each elementary stream by PID


def _carried(packets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the packets of one PID in order: where each one's payload starts (PACKET if it has none), after checking the continuity counters; and their adaptation flags. A repeated packet has none."""
    control, length = packets[:, 3] >> 4 & 3, packets[:, 4].astype(np.int32)
    has_field = (control & 2) != 0
    if (has_field & (length > np.where(control & 1, PACKET - 6, PACKET - 5))).any():
        raise ValueError("an adaptation field longer than its packet")
    flags = np.where(has_field & (length > 0), packets[:, 5], 0)
    start = np.where(control & 1, np.where(has_field, 5 + length, 4), PACKET)
    full = np.flatnonzero(control & 1)
    step = np.diff(packets[full, 3].astype(np.int32) & 15) % 16
    odd = np.flatnonzero(step != 1)
    for i in odd:
        if step[i] == 0 and (packets[full[i], 4:] == packets[full[i + 1], 4:]).all() and not (i and step[i - 1] == 0):
            start[full[i + 1]] = PACKET
        elif not (flags[full[i] + 1 : full[i + 1] + 1] & 0x80).any():
            raise ValueError("a gap in the continuity counters")
    return start, flags


def _section(data: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> bytes:
    """The first whole section of a table that is valid now."""
    packets = data[pid == wanted]
    start, _ = _carried(packets)
    unit_start = (packets[:, 1] & 0x40) != 0
    begins = np.flatnonzero(unit_start & (start < PACKET))
    for first, last in zip(begins, [*begins[1:], len(packets) - 1]):
        body = packets[first, start[first] :].tobytes()
        body = body[1 + body[0] :]
        for k in range(first + 1, last + 1):  # a section may end in the next section's first packet
            part = packets[k, start[k] :].tobytes()
            body += part[1 : 1 + part[0]] if part and unit_start[k] else part
        while len(body) >= 3 and body[0] != 0xFF:
            size = 3 + (struct.unpack_from(">H", body, 1)[0] & 0xFFF)
            section, body = body[:size], body[size:]
            if section[0] == table_id and len(section) == size and size >= 12 and section[5] & 1:
                if section_crc(section):
                    raise ValueError(f"wrong CRC of the section with PID {wanted}")
                return section
    raise ValueError(f"no section with PID {wanted}")


def _streams(pmt: bytes) -> dict[int, int]:
    """The type of each elementary stream by PID, in the table's order."""
    at, out = 12 + (struct.unpack_from(">H", pmt, 10)[0] & 0xFFF), {}
    while at + 5 <= len(pmt) - 4:
        out[struct.unpack_from(">H", pmt, at + 1)[0] & 0x1FFF] = pmt[at]
        at += 5 + (struct.unpack_from(">H", pmt, at + 3)[0] & 0xFFF)
    return out


def demux(stream: bytes | None, stream_pid: int | None = None) -> Stream:
    """The elementary stream of a PID, or of the first of the first program."""
    if not stream or len(stream) % PACKET:
        raise ValueError("no whole number of packets")
    data = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (data[:, 0] != 0x47).any():
        raise ValueError("a packet without sync byte")
    if (data[:, 1] & 0x80).any():
        raise ValueError("a packet with a transport error")
    pid = (data[:, 1].astype(np.int32) & 0x1F) << 8 | data[:, 2]
    pat = _section(data, pid, 0, 0)
    programs = {n: _streams(_section(data, pid, p & 0x1FFF, 2)) for n, p in struct.iter_unpack(">HH", pat[8:-4]) if n}
    known = {p: kind for streams in programs.values() for p, kind in streams.items()}
    if stream_pid is None:
        stream_pid = next(iter(known), None)
    if stream_pid not in known:
        raise ValueError("no such elementary stream" if known else "no program")
    rows = np.flatnonzero(pid == stream_pid)
    packets = data[rows]
    if (packets[:, 3] & 0xC0).any():
        raise ValueError("a scrambled packet")
    start, flags = _carried(packets)
    carried = packets[np.arange(PACKET) >= start[:, None]].tobytes()
    unit_start = ((packets[:, 1] & 0x40) != 0) & (start < PACKET)
    begins = (np.cumsum(PACKET - start) - (PACKET - start))[unit_start].tolist()
    if carried and begins[:1] != [0]:
        raise ValueError("the start of an elementary packet is missing")
    parts, times = [], []
    for at, end in zip(begins, [*begins[1:], len(carried)]):
        if end - at < 6 or carried[at : at + 3] != b"\0\0\1":
            raise ValueError("a broken elementary packet")
        kind, size = carried[at + 3], struct.unpack_from(">H", carried, at + 4)[0]
        if size and at + 6 + size != end:
            raise ValueError("a broken elementary packet")
        if kind in PLAIN_STREAMS:
            parts.append(carried[at + 6 : end])
            continue
        if end - at < 9 or at + 9 + carried[at + 8] > end:
            raise ValueError("a broken elementary packet")
        if carried[at + 7] & 0x80 and carried[at + 8] >= 5:
            times.append(_time_of(carried[at + 9 : at + 14]))
        parts.append(carried[at + 9 + carried[at + 8] : end])
    clocks = [(int.from_bytes(p[6:10].tobytes(), "big") << 1) | int(p[10]) >> 7 for p in packets[((flags & 0x10) != 0) & (packets[:, 4] >= 7)]]
    return Stream(b"".join(parts), known[stream_pid], len(data), times, rows[(flags & 0x40) != 0].tolist(), clocks, programs)


def encode_media(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column with the text's transport stream."""

    def run(ids, texts):
        made = [payload_of(t) for t in texts]
        return {"doc_id": ids, "n_bytes": [n for _, n in made], "media": [mux(p) for p, _ in made]}

    return map_text(df, run, "doc_id long, n_bytes long, media binary", rows=500)


_FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "first_time", "last_time", "n_random_access", "status")


def _features(stored: bytes | None) -> tuple:
    """_FEATURES of a stored stream; times are null if it has none, and all but the stored form's are null if it is refused."""
    whole = (len(stored), hashlib.sha256(stored).hexdigest()) if stored is not None else (None, None)
    try:
        got = demux(stored)
    except ValueError as reason:
        return (None, None, None, *whole, None, None, None, None, None, str(reason))
    payload, times = got.payload, got.times or [None]
    histogram = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
    feature = f"type={got.stream_type};packets={got.packets};access={len(got.random_access)};pts={times[0]}-{times[-1]};pcr={got.clocks[0] if got.clocks else None};levels={','.join(map(str, histogram.tolist()))}"
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *whole, feature, got.packets, times[0], times[-1], len(got.random_access), "ok")


def read_media(media: DataFrame) -> DataFrame:
    """Features of stored streams: payload and media sizes and digests, what the stream's tables and times say, and the status (``ok`` or why the stream is refused)."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, first_time long, last_time long, n_random_access long, status string")
    def read(column):
        import pandas as pd

        rows = pd.DataFrame([_features(stored) for stored in column], columns=_FEATURES)
        return rows.astype({c: "Int64" for c in _FEATURES if c not in ("payload_sha256", "media_sha256", "feature", "status")})

    return media.withColumn("read", read("media")).select("doc_id", "n_bytes", "read.*")


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(materialize(encode_media(documents(spark, sf_dir)), "media"))
