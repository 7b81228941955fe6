"""Transport streams of every document: the registered rows against payloads, digests and a plain reader that goes packet by packet."""

import hashlib
import zlib

import pytest

pytest.importorskip("framewright.llm")
from framewright.llm import transport_stream as S

FOLDER = "/root/testdata/sf0.001"


def plain_read(stream):
    """Payload, packets, times, random access points and first clock of a stream of 188-byte packets, with continuity held."""
    pmt, stream_pid, parts, times, access, first_clock, counters = None, None, [], [], 0, None, {}
    assert len(stream) % 188 == 0
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        pid, control, counter = (p[1] & 31) << 8 | p[2], p[3] >> 4 & 3, p[3] & 15
        body = p[4:]
        if control & 2:
            size, body = body[0], body[1:]
            flags = body[0] if size else 0
            if flags & 0x40:
                access += 1
            if flags & 0x10 and first_clock is None:
                first_clock = int.from_bytes(body[1:5], "big") << 1 | body[5] >> 7
            body = body[size:]
        if control & 1:
            assert pid not in counters or counter == (counters[pid] + 1) % 16
            counters[pid] = counter
        else:
            body = b""
        if pid == 0:
            section = body[1 + body[0] :]
            pmt = (section[10] & 31) << 8 | section[11]
        elif pid == pmt:
            section = body[1 + body[0] :]
            entry = section[12 + ((section[10] & 15) << 8 | section[11]) :]
            kind, stream_pid = entry[0], (entry[1] & 31) << 8 | entry[2]
        elif pid == stream_pid and body:
            if p[1] & 0x40:
                assert body[:3] == b"\0\0\1"
                if body[7] & 0x80:
                    t = body[9:14]
                    times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
                body = body[9 + body[8] :]
            parts.append(body)
    return b"".join(parts), kind, len(stream) // 188, times, access, first_clock


def test_registered_rows_of_every_document(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    media = {r.doc_id: r.media for r in S.encode_media(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    found = {r.doc_id: r for r in S.op10_transport_stream(spark, FOLDER).collect()}
    assert found.keys() == docs.keys() == media.keys()
    for i, text in docs.items():
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.status) == (len(media[i]), hashlib.sha256(media[i]).hexdigest(), "ok")
        got, kind, packets, times, access, clock = plain_read(media[i])
        assert got == payload and (r.n_packets, r.first_time, r.last_time, r.n_random_access) == (packets, times[0], times[-1], access)
        levels = [sum(b >> 5 == k for b in payload) for k in range(8)]
        assert r.feature == f"type={kind};packets={packets};access={access};pts={times[0]}-{times[-1]};pcr={clock};levels={','.join(map(str, levels))}"
