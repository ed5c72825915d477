"""Signatures, structure, carving, and the exact round trip of texts."""

import hashlib
import struct
import zlib

from talkloom.llm import media


def png(width=2, height=1):
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    rows = b"".join(b"\0" + bytes(3 * width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0" + bytes(6) + b"!\xf9\x04\0\0\0\0\0" + b",\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x02\0\x03\x01\x01\x11\0\xff\xda\0\x02\x12\xff\0\x34\xff\xd9"


def test_formats_are_carved_and_damage_is_refused():
    samples = [media.wrap(bytes([k]) * 192) for k in range(12)]
    for item, kind in [(png(), "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg")]:
        assert [(x[0], x[1], x[2]) for x in media.carve(b"BM P6\n junk" + item + b"tail")] == [(11, len(item), kind)]
        assert media.carve(item[:-1]) == []
    assert {media.carve(s)[0][2] for s in samples} == {"audio/wav", "image/bmp", "image/x-portable-pixmap"}
    for s in samples:
        assert media.carve(s[:-1]) == []
    damaged = bytearray(png())
    damaged[20] ^= 1
    assert media.carve(bytes(damaged)) == []
    both = b"--" + png() + b"--" + GIF
    assert [x[2] for x in media.carve(both)] == ["image/png", "image/gif"]


def test_round_trip_of_texts(spark):
    texts = [None, "", "a", "BM P6\n1 1\n255\n RIFF", "é" * 96, "x" * 193, "long " * 40_000, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, feature string")
    got = {r["doc_id"]: r for r in media.text_media(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        row = got[i if i else None]
        assert row["n_bytes"] == len(raw) and row["payload_bytes"] == len(payload)
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-16:])
        assert row["media_sha256"] == hashlib.sha256(media.wrap(payload)).hexdigest() and row["media_bytes"] == len(media.wrap(payload))
        assert row["corrected"] == (row["media_type"] != "audio/wav") and row["offset"] == 8
    assert {k: got[7][k] for k in ("media_sha256", "feature")} == {k: got[8][k] for k in ("media_sha256", "feature")}
    assert media.text_media(docs.limit(0)).count() == 0


def test_unknown_bytes_give_a_row_without_type(spark):
    blobs = spark.createDataFrame([(1, None, None), (2, bytearray(b"plain"), "image/png"), (3, bytearray(png() + GIF), None)], "id int, content binary, declared string")
    rows = media.sniff(blobs, ["id"]).collect()
    assert sorted((r["id"], r["media_type"] or "", r["corrected"]) for r in rows) == [(1, "", False), (2, "", False), (3, "image/gif", True), (3, "image/png", True)]
    assert bytes(next(r for r in rows if r["media_type"] == "image/gif")["media"]) == GIF
