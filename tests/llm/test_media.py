import hashlib
import struct
import zlib

import pytest

from lodestone.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * 256, 64 * 256 + 1, 64 * 700, 1_000_003])
def test_round_trip(n):
    raw = bytes(i * 7 % 251 for i in range(n))
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw) and not payload[n:].strip(b"\0")
    data = media.wrap(payload)
    (track,) = media.parse(data)
    assert media.read_payload(data, track) == payload
    units = len(payload) // 64
    assert (track.codec, len(track.sizes), track.seconds) == ("raw ", units, len(payload) / 8000)
    keys = track.keyframe_ranges()
    assert len(keys) == -(-units // 16)
    assert all(data[a:b] == payload[k * 1024 : k * 1024 + 64] for k, (a, b) in enumerate(keys))
    assert track.times.tolist() == [i * 64 for i in range(units)]


def test_other_layouts():
    """Sizes of their own, two chunks apart, no sync table, short headers, the movie first."""
    box, full = media._box, media._full
    entry = box(b"avc1", bytes(6), struct.pack(">H", 1), bytes(70))
    body = b"AAAAbb----CCCCCCd"

    def moov(at):
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">5I", 2, 1, 10, 3, 20)),
            full(b"stsc", struct.pack(">4I", 1, 1, 2, 1)), full(b"stsz", struct.pack(">6I", 0, 4, 4, 2, 6, 1)),
            full(b"stco", struct.pack(">3I", 2, at, at + 10)),
        )
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 100, 70), bytes(4)), box(b"minf", stbl))
        return box(b"moov", box(b"trak", mdia))

    at = len(moov(0)) + 8
    data = moov(at) + box(b"mdat", body) + struct.pack(">I4s", 0, b"free")
    (track,) = media.parse(data)
    assert (track.codec, track.seconds) == ("avc1", 0.7)
    assert media.read_payload(data, track) == b"AAAAbbCCCCCCd"
    assert track.keyframe_ranges() == [(at, at + 4), (at + 4, at + 6), (at + 10, at + 16), (at + 16, at + 17)]
    assert track.times.tolist() == [0, 10, 30, 50]


def test_damaged_files(spark):
    good = media.wrap(media.padded(b"x" * 1000))
    broken = [good[:n] for n in range(0, len(good), 37)] + [b"", b"\0" * 20, good[:4] + b"moov" + good[8:]]
    for data in broken:
        with pytest.raises(media.MediaError):
            media.parse(data)
    rows = [("a", good, 1), ("b", good[:500], 1), ("c", None, 1), ("d", b"", 1), (None, good, 1)]
    got = media.describe(spark.createDataFrame(rows, "path string, content binary, error int")).collect()
    assert [(r.codec, r.samples) for r in got] == [("raw ", 16), (None, None), (None, None), (None, None), ("raw ", 16)]
    assert [r.error is None for r in got] == [True, False, False, False, True]
    assert got[0].keyframes[0].end - got[0].keyframes[0].start == 64


def test_query(spark):
    from lodestone.llm.queries import op3_media

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_media(spark, sf).collect()
    assert len(rows) == len(texts)
    seen = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.media_sha256 == hashlib.sha256(media.wrap(payload)).hexdigest()
        assert seen.setdefault(raw, (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "", 0), (3, "é" * 200000, 0), (3, "é" * 200000, 0)], "doc_id long, text string, feature int")
    got = media.store_texts(df).collect()
    assert [(r.n_bytes, r.payload_bytes) for r in got] == [(0, 64), (0, 64), (400000, 400000), (400000, 400000)]
    assert media.store_texts(df.limit(0)).count() == 0
