"""Media columns from ISO base media files.

``parse`` walks the nested boxes of a file, decodes its sample tables, and gives codec, duration and the byte ranges of
keyframes without touching payload bytes. ``wrap`` stores a payload losslessly as 8-bit samples in such a file: one
track of unsigned 8-bit mono PCM ("raw ") whose access units hold ``UNIT`` samples, with every ``SYNC``-th marked as a
keyframe, so that the sample tables have something to say.

Defined results: a null or empty payload is a single unit of zeros; a file cut short, with a box that says it's longer
than what holds it, or without the needed boxes raises ``MediaError`` in ``parse`` and gives nulls with the reason in
``error`` as columns; equal payloads give equal files; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.session import ship_package

#: Samples (bytes) in an access unit, units in a chunk, and the distance of keyframes, of the files that wrap() makes.
UNIT = 64
CHUNK_UNITS = 256
SYNC = 16
RATE = 8000

# Boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MediaError(ValueError):
    """What is wrong with a file."""


# ---------------------------------------------------------------- writing


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes) -> bytes:
    """Zeros up to a positive multiple of UNIT."""
    return payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))


def wrap(payload: bytes) -> bytes:
    """A file whose media data is the payload (a positive multiple of UNIT bytes)."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise MediaError("a payload is a positive multiple of the unit")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    wide = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(ftyp) + len(head)
    chunks = -(-units // CHUNK_UNITS)
    offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK_UNITS * UNIT
    last = units - (chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS)] * (chunks > 1) + [(chunks, last)] * (last != CHUNK_UNITS or chunks == 1)
    keys = np.arange(1, units + 1, SYNC, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    far = bool(offsets[-1] >= 1 << 32)
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, units, UNIT)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", c, n, 1) for c, n in runs]),
        _full(b"stsz", struct.pack(">II", UNIT, units)),
        _full(b"co64" if far else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if far else ">u4").tobytes()),
    )
    length = units * UNIT
    mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1)
    hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"bytes\0")
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xhhh2x", 0, 0, 1, 0, length, 0, 0, 0x100), MATRIX, bytes(8), version=1, flags=7)
    trak = _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf))
    mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, length, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    return b"".join([ftyp, head, payload, _box(b"moov", mvhd, trak)])


# ---------------------------------------------------------------- reading


def walk(data: memoryview, start: int = 0, stop: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, first body byte, end) of every box, containers before what they hold."""
    stop = len(data) if stop is None else stop
    pending = [(path, start, stop)]
    while pending:
        path, at, stop = pending.pop()
        if at == stop:
            continue
        if stop - at < 8:
            raise MediaError(f"{stop - at} stray bytes in {path or 'file'}")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if stop - at < 16:
                raise MediaError("a long box without its size")
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = stop - at
        if size < body - at or at + size > stop:
            raise MediaError(f"box {kind.decode('latin-1')} leaves {path or 'file'}")
        name = f"{path}/{kind.decode('latin-1')}" if path else kind.decode("latin-1")
        yield name, body, at + size
        pending.append((path, at + size, stop))
        if kind in CONTAINERS:
            pending.append((name, body, at + size))


def _table(data: memoryview, body: int, end: int, columns: int, kind: str = ">u4") -> np.ndarray:
    count = struct.unpack_from(">I", data, body + 4)[0]
    width = columns * np.dtype(kind).itemsize
    if body + 8 + count * width > end:
        raise MediaError("a sample table is longer than its box")
    return np.frombuffer(data, kind, count * columns, body + 8).astype(np.int64).reshape(count, columns)


@dataclass
class Track:
    """A track's sample tables, decoded: one entry per sample."""

    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    times: np.ndarray
    keyframes: np.ndarray

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        first = self.offsets[self.keyframes]
        return list(zip(first.tolist(), (first + self.sizes[self.keyframes]).tolist(), strict=True))

    def runs(self) -> list[tuple[int, int]]:
        """Byte ranges of all samples in order, neighbours joined."""
        ends = self.offsets + self.sizes
        cut = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        starts = self.offsets[np.r_[0, cut]] if len(ends) else []
        return list(zip(map(int, starts), map(int, ends[np.r_[cut - 1, len(ends) - 1]] if len(ends) else []), strict=True))


def _track(data: memoryview, boxes: dict[str, tuple[int, int]]) -> Track:
    stbl = "moov/trak/mdia/minf/stbl/"
    try:
        mdhd, stsd, stsz, stts, stsc = (boxes[k] for k in ("moov/trak/mdia/mdhd", stbl + "stsd", stbl + "stsz", stbl + "stts", stbl + "stsc"))
        wide = stbl + "co64" in boxes
        chunk = boxes[stbl + "co64"] if wide else boxes[stbl + "stco"]
    except KeyError as missing:
        raise MediaError(f"no {missing.args[0]}") from None
    try:
        long_ = data[mdhd[0]] == 1
        timescale, duration = struct.unpack_from(">IQ" if long_ else ">II", data, mdhd[0] + (20 if long_ else 12))
        codec = bytes(data[stsd[0] + 12 : stsd[0] + 16]).decode("latin-1")
        each, count = struct.unpack_from(">II", data, stsz[0] + 4)
        if each:
            sizes = np.full(count, each, dtype=np.int64)
        else:
            sizes = np.frombuffer(data, ">u4", count, stsz[0] + 12).astype(np.int64)
    except (struct.error, ValueError, IndexError) as error:
        raise MediaError(f"a box is cut short: {error}") from None
    chunks = _table(data, *chunk, 1, ">u8" if wide else ">u4")[:, 0]
    runs = _table(data, *stsc, 3)
    timing = _table(data, *stts, 2)
    first = runs[:, 0] - 1
    per_chunk = np.repeat(runs[:, 1], np.diff(np.r_[first, len(chunks)])) if len(runs) else np.zeros(0, np.int64)
    if len(per_chunk) != len(chunks) or per_chunk.sum() != count or timing[:, 0].sum() != count:
        raise MediaError("the sample tables don't agree")
    offsets = np.zeros(count, dtype=np.int64)
    if count:
        before = np.cumsum(sizes) - sizes  # bytes before each sample, from the first on
        start = np.cumsum(per_chunk) - per_chunk
        held = per_chunk > 0
        base = np.repeat(chunks[held] - before[start[held]], per_chunk[held])
        offsets = base + before
        if offsets.min() < 0 or int((offsets + sizes).max()) > len(data):
            raise MediaError("samples lie outside the file")
    delta = np.repeat(timing[:, 1], timing[:, 0])
    stss = boxes.get(stbl + "stss")
    keys = _table(data, *stss, 1)[:, 0] - 1 if stss else np.arange(count)
    if len(keys) and (keys.min() < 0 or keys.max() >= count):
        raise MediaError("a keyframe that is no sample")
    return Track(codec, timescale, duration, offsets, sizes, np.cumsum(delta) - delta, keys)


def parse(data: bytes) -> list[Track]:
    """The tracks of a file."""
    view, tracks, boxes, movie = memoryview(data), [], {}, False
    for path, body, end in walk(view):
        movie |= path == "moov"
        if path == "moov/trak":
            boxes = {}
            tracks.append(boxes)
        if path.startswith("moov/trak/"):
            boxes.setdefault(path, (body, end))
    if not movie:
        raise MediaError("no moov")
    return [_track(view, b) for b in tracks]


def read_payload(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples."""
    return b"".join(data[a:b] for a, b in track.runs())


def feature(track: Track) -> str:
    keys = track.keyframe_ranges()
    digest = zlib.crc32(np.array(keys, dtype="<i8").tobytes())
    return (
        f"codec={track.codec.strip()};seconds={track.seconds:.6f};samples={len(track.sizes)};keyframes={len(keys)};"
        f"first={keys[0][0]}-{keys[0][1]};last={keys[-1][0]}-{keys[-1][1]};ranges_crc32={digest}"
    )


# ---------------------------------------------------------------- columns


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for part, texts in slices(batches, "__text"):
        rows = []
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            media = wrap(padded(raw))
            track = parse(media)[0]
            back = read_payload(media, track)
            rows.append((len(raw), len(back), sha(back), zlib.crc32(back[-64:]), len(media), sha(media), feature(track)))
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])]
        yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["__id", *STORED])


STORED = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's bytes stored as media, read back, with what was found."""
    ship_package(df.sparkSession)
    narrow = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    kind = narrow.schema["__id"].dataType.simpleString()
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return narrow.mapInArrow(_stored, f"__id {kind}, {schema}").withColumnRenamed("__id", id_col)


MEDIA = "codec string, seconds double, samples long, keyframes array<struct<start:bigint,end:bigint>>, error string"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for value in batch.column(batch.num_columns - 1):
            row: tuple = (None, None, None, None, "no data")
            data = value.as_py()
            if data is not None:
                try:
                    tracks = parse(data)
                    row = (None, None, None, None, "no track")
                    if tracks:
                        t = max(tracks, key=lambda t: len(t.sizes))
                        row = (t.codec, t.seconds, len(t.sizes), [{"start": a, "end": b} for a, b in t.keyframe_ranges()], None)
                except MediaError as error:
                    row = (None, None, None, None, str(error))
            for column, x in zip(out, row):
                column.append(x)
        kinds = [pa.string(), pa.float64(), pa.int64(), ranges, pa.string()]
        columns = [pa.array(c, k) for c, k in zip(out, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["__id", "codec", "seconds", "samples", "keyframes", "error"])


def describe(df: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """Codec, duration and keyframe byte ranges of binary columns, such as those of spark.read.format("binaryFile")."""
    ship_package(df.sparkSession)
    narrow = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{content_col}`").alias("__content"))
    kind = narrow.schema["__id"].dataType.simpleString()
    return narrow.mapInArrow(_described, f"__id {kind}, {MEDIA}").withColumnRenamed("__id", id_col)
