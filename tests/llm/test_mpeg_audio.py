import hashlib
import struct
import zlib

import pytest
from geoloom.llm import mpeg_audio as m
from geoloom.llm.queries import QUERIES


def test_round_trip_and_padding():
    for raw in (b"", b"x", bytes(575), bytes(576), "Grüße ".encode() * 700, bytes(range(256)) * 9):
        payload = m.pad(raw)
        assert len(payload) % 576 == 0 and payload and payload.startswith(raw)
        s = m.read_stream(m.write_stream(payload))
        assert s.payload == payload
        assert (s.crc_bad, s.skipped, s.crc_good) == (0, 0, len(payload) // 576 + 1)
        assert s.samples == 1152 * len(payload) // 576 and s.table["frames"] == len(s.offsets)


def test_resynchronises_after_damage():
    stream = bytearray(m.write_stream(m.pad(b"y" * 5000)))
    whole = m.read_stream(bytes(stream))
    at = whole.offsets[3]
    hurt = bytes(stream[:at]) + b"\xff\x00junk\xff\xe0" + bytes(stream[at:])
    s = m.read_stream(hurt)
    assert len(s.offsets) == len(whole.offsets) and s.skipped == 8 and s.offsets[3] == at + 8
    stream[at + 10] ^= 1
    assert m.read_stream(bytes(stream)).crc_bad == 1
    assert m.read_stream(b"").offsets == [] and m.read_stream(b"\xff" * 999).offsets == []


def test_headers_of_other_kinds():
    h = m.header(b"\xff\xfb\x90\x00")
    assert (h.rate, h.hertz, h.size, h.samples, h.layer) == (128, 44100, 417, 1152, 3)
    assert m.header(b"\xff\xf3\x44\xc4").hertz == 24000
    assert m.header(b"\xff\xeb\x90\x00") is None and m.header(b"\xff\xfb\xf0\x00") is None


def test_variable_bitrate_tables_and_tags():
    head = m.header(m.HEADER)
    frame = m.HEADER + bytes(34) + b"Xing" + struct.pack(">II", 1, 77)
    assert m.vbr_table(frame, head) == {"kind": "Xing", "frames": 77}
    vbri = m.HEADER + bytes(32) + b"VBRI" + bytes(6) + struct.pack(">IIHHHH", 9, 8, 2, 3, 2, 1) + b"\x00\x01\x00\x02"
    assert m.vbr_table(vbri, head)["seek"] == [3, 6]
    body = m.write_stream(m.pad(b"z"))
    s = m.read_stream(body + b"TAG" + bytes(125))
    assert s.tags == 28 + 128 and len(s.offsets) == 1


def test_digests(spark):
    texts = [(1, "a"), (2, "a"), (3, None), (None, "é" * 1000), (5, "")]
    df = spark.createDataFrame([(*x, "q") for x in texts], "doc_id bigint, text string, media string")
    stored = m.store_texts(df)
    out = {r.doc_id: r for r in m.stored_digests(stored).collect()}
    assert out[1].media_sha256 == out[2].media_sha256 and out[3].payload_sha256 == out[5].payload_sha256
    assert out[None].n_bytes == 2000 and out[None].payload_bytes == 2304
    assert out[1].tail_crc32 == zlib.crc32(b"\xff" * 32)
    assert m.media_columns(stored.where("doc_id = 1"), "doc_id", "media").first().duration_s == 1152 / 48000
    assert m.stored_digests(m.store_texts(df.limit(0))).count() == 0


@pytest.mark.parametrize("units", [1, 4])
def test_bytes_like_tags_in_the_payload(units):
    """Tags at the back are looked for behind the frames only."""
    size = units * m.UNIT
    for word in (b"TAG", b"APETAGEX", b"ID3"):
        for at in [*range(size - 160, size - len(word) + 1), 0]:
            payload = bytearray(b"\xff" * size)
            payload[at : at + len(word)] = word
            if at >= size - 128 and word == b"TAG":
                payload[size - 160 : size - 152] = b"APETAGEX"
                payload[size - 148 : size - 144] = (700).to_bytes(4, "little")
            media = m.write_stream(bytes(payload))
            assert m.read_stream(media).payload == bytes(payload)
            tagged = m.read_stream(media + b"TAG".ljust(128, b"x"))
            assert tagged.payload == bytes(payload) and tagged.skipped == 0


@pytest.mark.parametrize("units", [1, 2, 3, 4, 5])
def test_footers_that_point_at_frames(units):
    """A footer in the last frame's payload may claim any size, that of whole frames too."""
    size, empty = units * m.UNIT, len(m.write_stream(m.pad(b"")))
    frame = len(m.write_stream(bytes(2 * m.UNIT))) - empty
    for foot in (474, m.UNIT - 32 - 128, m.UNIT - 32):
        for back in range(1, units + 2):
            for off in (-32, 0, 32):
                payload = bytearray(b"a" * size)
                at = size - m.UNIT + foot
                payload[at : at + 8] = b"APETAGEX"
                payload[at + 12 : at + 16] = max(0, back * frame + off - (m.UNIT - foot)).to_bytes(4, "little")
                for tag in (506, m.UNIT - 128, m.UNIT - 66):
                    text = bytearray(payload)
                    text[size - m.UNIT + tag : size - m.UNIT + tag + 3] = b"TAG"
                    assert m.read_stream(m.write_stream(bytes(text))).payload == bytes(text)
    for claim in range(0, 3000, 4):
        payload = bytearray(b"b" * size)
        payload[-102:-94], payload[-90:-86], payload[-70:-67] = b"APETAGEX", claim.to_bytes(4, "little"), b"TAG"
        assert m.read_stream(m.write_stream(bytes(payload))).payload == bytes(payload)


def test_whole_table(spark):
    """Every contract column, recomputed from the texts."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = QUERIES["op9_media"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        media = m.write_stream(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.count("/") == len(payload) // 576 - 1
