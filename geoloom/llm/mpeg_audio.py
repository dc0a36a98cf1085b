"""MPEG audio as a column: write, resynchronise, parse, verify, index.

``write_stream`` stores bytes losslessly in the ancillary part of silent MPEG-1
layer III frames, each protected by its CRC-16, behind an ID3v2 tag and an
information frame with frame count, byte count and a 100-entry seek table.
``read_stream`` reads any byte string: it skips tags, looks for frame headers
(again after damage), parses the tables of variable-bitrate files, verifies
checksums, and gives the exact duration and each frame's offset. A frame's checksum
covers its header and side bytes, as the format has it, so it finds damage there only.

Edge cases: null bytes or text are empty; a payload is never empty (it is
padded to a positive multiple of 576); input without any frame gives zero
frames and an empty payload; equal inputs give equal outputs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, text_of

#: Payload bytes in a frame, and the byte that fills the last one.
UNIT, FILL = 576, b"\xff"
#: Fixed values of the format: kbit/s by (MPEG-1?, layer), Hz by version, side bytes of layer III by (MPEG-1?, mono?).
RATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}
#: MPEG-1 layer III, with CRC, 224 kbit/s, 48 kHz, stereo: 672 bytes a frame.
HEADER = b"\xff\xfa\xc4\x00"
FRAME, BODY = 672, 38


class Header(NamedTuple):
    version: int
    layer: int
    crc: bool
    rate: int
    hertz: int
    mono: bool
    size: int
    samples: int


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, if they hold a usable one."""
    if len(four) < 4 or four[0] != 255 or four[1] < 224:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, hertz, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    first, kbit, hz = version == 3, RATES[version == 3, layer][rate], HERTZ[version][hertz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * kbit * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + pad
    return Header(version, layer, not four[1] & 1, kbit, hz, four[3] >> 6 == 3, size, samples)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 and start 0xFFFF, as frames carry it."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def synchsafe(n: int) -> bytes:
    return bytes(n >> shift & 127 for shift in (21, 14, 7, 0))


def pad(data: bytes) -> bytes:
    """Fills up to a positive multiple of the unit."""
    return data + FILL * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def write_stream(payload: bytes) -> bytes:
    """A tagged stream whose frames hold the padded payload."""
    n = len(payload) // UNIT
    lead = HEADER + crc16(HEADER[2:] + bytes(32)).to_bytes(2, "big") + bytes(32)
    total = FRAME * (n + 1)
    table = bytes(min(255, i * 256 // 100) for i in range(100))
    info = lead + b"Info" + struct.pack(">III", 7, n, total) + table
    label = b"TSSE" + struct.pack(">IH", 8, 0) + b"\x03payload"
    tag = b"ID3\x04\x00\x00" + synchsafe(len(label)) + label
    tail = bytes(FRAME - BODY - UNIT)
    body = b"".join([x for i in range(0, len(payload), UNIT) for x in (lead, payload[i : i + UNIT], tail)])
    return tag + info.ljust(FRAME, b"\x00") + body


class Stream(NamedTuple):
    tags: int
    offsets: list[int]
    samples: int
    hertz: int
    crc_good: int
    crc_bad: int
    skipped: int
    table: dict
    payload: bytes


def front_tags(data: bytes) -> int:
    """Bytes of the tags at the front."""
    front = 0
    while data[front : front + 3] == b"ID3" and len(data) >= front + 10:
        size = 0
        for b in data[front + 6 : front + 10]:
            size = size << 7 | b & 127
        front += 10 + size + (10 if data[front + 5] & 16 else 0)
    return min(front, len(data))


def back_tags(data: bytes) -> set[int]:
    """Where tags at the back might start. The same bytes may stand inside frames, so they are tags only if no frame is there or behind."""
    end, starts = len(data), set()
    if end >= 128 and data[-128:-125] == b"TAG":
        starts.add(end - 128)
    for back in {end, *starts}:
        foot = data[back - 32 : back] if back >= 32 else b""
        if foot[:8] == b"APETAGEX":
            start = back - struct.unpack("<I", foot[12:16])[0] - (32 if foot[23] & 128 else 0)
            starts |= {start} if 0 <= start < back else set()
    return starts


def vbr_table(frame: bytes, head: Header) -> dict:
    """The frame, byte and seek fields of an information frame; empty if it is none."""
    at = 4 + 2 * head.crc + SIDE[head.version == 3, head.mono]
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        return out | ({"seek": list(frame[at : at + 100])} if flags & 4 else {})
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, step = struct.unpack(">IIHHHH", frame[46:62])
        points = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "step": step, "seek": points}
    return {}


def read_stream(data: bytes, unit: int = UNIT) -> Stream:
    """Reads frames wherever they are; a header counts if a like one, a tag or the end follows its frame.

    Frames go before tags: only where no more frame is found the rest is searched for a tag.
    """
    front, backs = front_tags(data), back_tags(data)
    at, end, back = front, len(data), 0
    offsets, parts, good, bad, skipped, samples, hertz, table = [], [], 0, 0, 0, 0, 0, {}
    locked = None

    def frame_at(here: int) -> Header | None:
        head = header(data[here : here + 4])
        if not head or here + head.size > end:
            return None
        kind, follow = (head.version, head.layer, head.hertz), data[here + head.size : here + head.size + 4]
        like = header(follow) if len(follow) == 4 else None
        fits = len(follow) < 4 or here + head.size in backs or (like and (like.version, like.layer, like.hertz) == kind)
        return head if fits or kind == locked else None

    while at + 4 <= end:
        head = frame_at(at)
        if not head:
            to = data.find(b"\xff", at + 1, end)
            while to >= 0 and not frame_at(to):
                to = data.find(b"\xff", to + 1, end)
            if to < 0:
                to = min((b for b in backs if b >= at), default=end)
                back, skipped, at = end - to, skipped + to - at, end
                break
            skipped, at = skipped + to - at, to
            continue
        locked, hertz = (head.version, head.layer, head.hertz), head.hertz
        side = SIDE[head.version == 3, head.mono] if head.layer == 3 else 0
        if head.crc and head.layer == 3:
            right = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]) == int.from_bytes(data[at + 4 : at + 6], "big")
            good, bad = good + right, bad + (not right)
        if not offsets and not table and (table := vbr_table(data[at : at + head.size], head) if head.layer == 3 else {}):
            at += head.size
            continue
        offsets.append(at)
        samples += head.samples
        start = at + 4 + 2 * head.crc + side
        parts.append(data[start : min(start + unit, at + head.size)])
        at += head.size
    return Stream(front + back, offsets, samples, hertz, good, bad, skipped + max(0, end - at), table, b"".join(parts))


def feature(s: Stream) -> str:
    """All that is read from a stream but its payload, as text."""
    seeks = "/".join(map(str, s.offsets))
    return f"frames={len(s.offsets)};samples={s.samples};hertz={s.hertz};crc={s.crc_good}:{s.crc_bad};table={s.table.get('kind', '')}:{s.table.get('frames', 0)}:{s.table.get('bytes', 0)};tags={s.tags};skipped={s.skipped};seek={seeks}"


def media_columns(streams: DataFrame, key: str, column: str) -> DataFrame:
    """Duration, offsets and checks of a binary column: one row for each input row."""

    def make():
        def one(batch):
            rows = [read_stream(x or b"") for x in batch["media"].to_pylist()]
            return {"key": batch["key"], "frames": [len(s.offsets) for s in rows], "samples": [s.samples for s in rows], "hertz": [s.hertz for s in rows], "duration_s": [s.samples / s.hertz if s.hertz else 0.0 for s in rows], "crc_bad": [s.crc_bad for s in rows], "skipped_bytes": [s.skipped for s in rows], "frame_offsets": [s.offsets for s in rows]}

        return one

    out = "key bigint, frames bigint, samples bigint, hertz int, duration_s double, crc_bad bigint, skipped_bytes bigint, frame_offsets array<bigint>"
    return map_columns(streams.select(F.col(key).cast("bigint").alias("key"), F.col(column).alias("media")), out, make).withColumnRenamed("key", key)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, the unpadded size, and each text as a stored audio stream."""

    def make():
        def one(batch):
            raw = [t.encode() for t in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "n_bytes": [len(x) for x in raw], "media": [write_stream(pad(x)) for x in raw]}

        return one

    return map_columns(docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")), "doc_id bigint, n_bytes bigint, media binary", make)


def stored_digests(stored: DataFrame) -> DataFrame:
    """Reads stored streams back and digests payload, stream and features."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s"]

    def make():
        sha = hashlib.sha256

        def one(batch):
            rows = []
            for media in batch["media"].to_pylist():
                s = read_stream(media)
                rows.append((len(s.payload), sha(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), sha(media).hexdigest(), feature(s), s.samples / s.hertz if s.hertz else 0.0))
            return {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"]} | dict(zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True))

        return one

    return map_columns(stored, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_s double", make)
