"""Media columns: documents stored in and read back from MPEG transport streams.

Writing: 188-byte packets; a program association table (PID 0), a program map table, and one elementary stream of 8-bit
samples (private data, stream type 6) in packetised units of UNIT bytes. Each unit opens with a random-access flag, a
program clock reference and a presentation timestamp at 90 kHz (SAMPLE_RATE samples a second).
Reading: the tables are put together over the packets that they span, parsed, and their CRC checked; continuity counters of each PID are
checked (packets without a payload and packets sent twice are legal); packets are put together to elementary packets; and the timestamps
(90 kHz) and random-access points (positions of samples) are columns of their own.

Defined cases: null text is empty and stored as 64 zero bytes; a null doc_id is passed on; repeated rows give repeated rows;
equal texts give equal streams; other columns are ignored. A damaged stream raises ValueError naming the fault.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm._util import chunks, id_and_text, table, text_buffer

PACKET = 188
PMT_PID, STREAM_PID, PROGRAM = 0x100, 0x101, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Samples in one elementary packet, and samples a second.
UNIT, SAMPLE_RATE = 8192, 8000
CLOCK = 90_000

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c
_CRC_LIST = _CRC.tolist()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC_LIST[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet.ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _timestamp(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 1 | t >> 14 & 0xFE, t >> 7 & 0xFF, 1 | t << 1 & 0xFE])


def _clock(t: int) -> bytes:
    return (t << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload's bytes as samples."""
    out, counter = [_PAT, _PMT], 0
    for start in range(0, len(payload), UNIT):
        unit = payload[start : start + UNIT]
        t = start * CLOCK // SAMPLE_RATE & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(t) + unit
        room = PACKET - 12
        lead = 7 + max(0, room - len(pes))
        out.append(bytes([0x47, 0x40 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter, lead, 0x50]) + _clock(t) + b"\xff" * (lead - 7) + pes[:room])
        counter = counter + 1 & 15
        rest = pes[room:]
        full = len(rest) // 184
        if full:
            body = np.empty((full, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 0xFF
            body[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            body[:, 4:] = np.frombuffer(rest, np.uint8, full * 184).reshape(full, 184)
            out.append(body.tobytes())
            counter = counter + full & 15
        if tail := rest[full * 184 :]:
            pad = 183 - len(tail)
            field = bytes([pad]) + (b"\x00" + b"\xff" * (pad - 1) if pad else b"")
            out.append(bytes([0x47, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter]) + field + tail)
            counter = counter + 1 & 15
    return b"".join(out)


def _payload(row: bytes) -> bytes:
    """What a packet carries after its header and adaptation field; nothing if it has no payload."""
    if not row[3] & 0x10:
        return b""
    return row[5 + row[4] :] if row[3] & 0x20 else row[4:]


def _checked(own: np.ndarray, what: str) -> tuple[np.ndarray, np.ndarray]:
    """One PID's packets with a payload, each once, and for each whether a random-access point is told at or before it.

    Legal are packets without a payload, whose counter stands still, and a packet that is sent twice; a flagged discontinuity starts a new count."""
    if (own[:, 1] & 0x80).any():
        raise ValueError(f"{what}: a packet is marked as damaged")
    if len(own) == 1 and own[0, 3] & 0x10:
        return own, np.array([own[0, 3] & 0x20 != 0 and own[0, 4] > 0 and own[0, 5] & 0x40 != 0])
    loaded, fielded = own[:, 3] & 0x10 != 0, (own[:, 3] & 0x20 != 0) & (own[:, 4] > 0)
    flags = np.where(fielded, own[:, 5], 0)
    access, restart = flags & 0x40 != 0, flags & 0x80 != 0
    if not loaded.all():  # flags of packets without a payload hold for the next one with a payload
        carrier = np.append(np.flatnonzero(loaded), len(own))[np.searchsorted(np.flatnonzero(loaded), np.arange(len(own)))]
        for flag in (access, restart):
            told = carrier[np.flatnonzero(flag & ~loaded)]
            flag[told[told < len(own)]] = True
        own, access, restart = own[loaded], access[loaded], restart[loaded]
    counter = own[:, 3] & 15
    step = np.diff(counter.astype(np.int16)) & 15
    if ((step != 1) & ~restart[1:]).any():
        again = np.flatnonzero((step == 0) & ~restart[1:]) + 1
        again = again[[_payload(own[k].tobytes()) == _payload(own[k - 1].tobytes()) for k in again]] if len(again) else again
        kept = np.ones(len(own), bool)
        kept[again] = False
        if np.isin(again, again + 1).any():
            raise ValueError(f"{what}: a packet is sent more than twice")
        own, access, restart = own[kept], access[kept], restart[kept]
        step = np.diff((own[:, 3] & 15).astype(np.int16)) & 15
        if ((step != 1) & ~restart[1:]).any():
            raise ValueError(f"{what}: continuity counter jumps")
    return own, access


def _read_section(grid: np.ndarray, pids: np.ndarray, pid: int, what: str) -> bytes:
    """The first whole section of a PID, put together over as many packets as it spans."""
    own = grid[pids == pid]
    if not len(own):
        raise ValueError(f"no {what}")
    held: bytes | None = None
    for row in _checked(own, what)[0]:
        packet = row.tobytes()
        body = _payload(packet)
        if packet[1] & 0x40:
            held = body[1 + body[0] :] if held is None else held + body[1 : 1 + body[0]]
        elif held is not None:
            held += body
        if held is not None and len(held) >= 3 and len(held) >= (size := 3 + ((held[1] & 0x0F) << 8 | held[2])):
            if crc32_mpeg(held[:size]):
                raise ValueError(f"{what}: wrong CRC")
            return held[:size]
    raise ValueError(f"{what}: no whole section")


def demux(stream: bytes) -> dict:
    """samples, units, timestamps (90 kHz) and random-access points (sample positions) of the first program's first stream."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    grid = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pids = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    section = _read_section(grid, pids, 0, "program association table")
    programs = {section[i] << 8 | section[i + 1]: (section[i + 2] & 0x1F) << 8 | section[i + 3] for i in range(8, len(section) - 4, 4)}
    pmt_pid = next((pid for number, pid in sorted(programs.items()) if number), None)
    if pmt_pid is None:
        raise ValueError("the program association table names no program")
    section = _read_section(grid, pids, pmt_pid, "program map table")
    at = 12 + ((section[10] & 0x0F) << 8 | section[11])
    if at + 5 > len(section) - 4:
        raise ValueError("the program has no stream")
    stream_pid = (section[at + 1] & 0x1F) << 8 | section[at + 2]
    own = grid[pids == stream_pid]
    if not len(own):
        raise ValueError("the program's stream is missing")
    own, told = _checked(own, "stream")
    starts = np.flatnonzero(own[:, 1] & 0x40)
    if not len(starts) or starts[0]:
        raise ValueError("the stream does not open with an elementary packet")
    fielded = own[:, 3] & 0x20 != 0
    samples, timestamps, access, n = [], [], [], 0
    for lo, hi in zip(starts, [*starts[1:], len(own)], strict=True):
        parts, k = [], int(lo)
        if told[lo]:
            access.append(n)
        while k < hi:
            if fielded[k]:
                parts.append(_payload(own[k].tobytes()))
                k += 1
            else:
                stop = k + 1
                while stop < hi and not fielded[stop]:
                    stop += 1
                parts.append(own[k:stop, 4:].tobytes())
                k = stop
        pes = b"".join(parts)
        size = pes[4] << 8 | pes[5] if len(pes) > 8 else -1
        if pes[:3] != b"\x00\x00\x01" or size and len(pes) != size + 6:  # a size of 0 means up to the next one
            raise ValueError("broken elementary packet")
        if pes[7] & 0x80:
            p = pes[9:14]
            timestamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        samples.append(pes[9 + pes[8] :])
        n += len(samples[-1])
    return {"samples": b"".join(samples), "units": len(starts), "timestamps": timestamps, "access": access}


def payload_of(text: bytes) -> bytes:
    """The text's bytes with zeros appended up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def features(read: dict, n_bytes: int, media_bytes: int) -> str:
    values = np.frombuffer(read["samples"], np.uint8)
    times = read["timestamps"]
    return f"type={STREAM_TYPE};rate={SAMPLE_RATE};units={read['units']};access={len(read['access'])};last_access={read['access'][-1]};first_pts={times[0]};last_pts={times[-1]};packets={media_bytes // PACKET};sum={int(values.sum(dtype=np.int64))};peak={int(values.max())}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, access_points array<long>"


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Each text as a transport stream (column media, on request) with what reading it back shows."""
    fields = SCHEMA + ", media binary" * with_media
    kinds = [_KINDS[x.split()[1]] for x in fields.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            raw, at = text_buffer(part["text"])
            data, rows = raw.tobytes(), []
            for k in range(len(at) - 1):
                text = data[at[k] : at[k + 1]]
                media = mux(payload_of(text))
                read = demux(media)
                back = read["samples"]
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(read, len(text), len(media)), read["timestamps"], read["access"])
                rows.append((*row, media) if with_media else row)
            names = [x.split()[0] for x in fields.split(", ")][1:]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), *columns], ["doc_id", *names])

    return id_and_text(docs).mapInArrow(run, fields)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


__all__ = ["crc32_mpeg", "demux", "features", "media_columns", "mux", "op9", "payload_of"]
