"""Media columns: ISO base media containers, written and walked without decoding their payload.

A container is a tree of boxes: 32-bit size, four-character type, content. A track's sample tables (stts, stsc,
stsz, stco or co64, stss) say where each sample lies, how long it lasts and which ones are keyframes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A frame is 8 x 8 pixels of three 8-bit samples; every 12th is marked as a keyframe; 64 make a chunk.
EDGE, FRAME, KEY_EVERY, CHUNK_FRAMES = 8, 192, 12, 64
#: Frames of 40 in a second of 1000 units.
TIMESCALE, FRAME_TICKS = 1000, 40
#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf", b"udta")
#: Boxes nested deeper than this are not walked.
DEPTH = 16
_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Box(NamedTuple):
    kind: bytes
    start: int  # of the content
    end: int
    path: tuple[bytes, ...]


class Track(NamedTuple):
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray  # of each sample in the file
    sizes: np.ndarray
    keyframes: np.ndarray  # sample numbers from 0


def _box(kind: bytes, *parts: bytes) -> bytes:
    content = b"".join(parts)
    return struct.pack(">I", len(content) + 8) + kind + content


def _full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def container(payload: bytes) -> bytes:
    """A file with one uncompressed video track whose frames are the payload, a positive multiple of 192 bytes.

    Nothing depends on time or place, so equal payloads give equal files. Chunk offsets have 64 bits, and so has the
    media box's size where 32 bits do not hold it.
    """
    frames = len(payload) // FRAME
    if not frames or len(payload) % FRAME:
        raise ValueError(f"the payload's length must be a positive multiple of {FRAME}")
    ticks, chunks = frames * FRAME_TICKS, -(-frames // CHUNK_FRAMES)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] if last == CHUNK_FRAMES else [(1, CHUNK_FRAMES, 1), (chunks, last, 1)] if chunks > 1 else [(1, last, 1)]
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", EDGE, EDGE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 24, -1)
    )
    keys = np.arange(1, frames + 1, KEY_EVERY).astype(">u4")
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp42")

    def moov(first: int) -> bytes:
        offsets = (first + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * FRAME).astype(">u8")
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME_TICKS)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *run) for run in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64", struct.pack(">I", chunks), offsets.tobytes()),
        )
        place = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
            _full(b"hdlr", struct.pack(">I", 0), b"vide", bytes(12), b"frames\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), place, table),
        )
        track = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(16), _UNITY, struct.pack(">II", EDGE << 16, EDGE << 16), flags=7, version=1)
        movie = _full(b"mvhd", struct.pack(">QQIQIHH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100, 0), bytes(8), _UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", movie, _box(b"trak", track, media))

    large = len(payload) + 8 >= 1 << 32
    mark = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    size = len(moov(0))
    return b"".join((head, moov(len(head) + size + len(mark)), mark, payload))


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[Box]:
    """All boxes, parents first. A size of 0 reaches to the end, 1 is followed by 64 bits; a box that would leave its
    parent ends the walk at that level, as does a rest of under 8 bytes."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind, head = struct.unpack_from(">I", data, start)[0], bytes(data[start + 4 : start + 8]), 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield Box(kind, start + head, start + size, path)
        if kind in CONTAINERS and len(path) < DEPTH:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _numbers(data: bytes | memoryview, box: Box, skip: int, kind: str, width: int = 1) -> np.ndarray:
    """A table of ``width`` columns behind a full box's version, ``skip`` bytes and a count, as far as the box reaches."""
    first = box.start + 8 + skip
    if first > box.end:
        return np.zeros((0, width), np.int64)
    count = struct.unpack_from(">I", data, first - 4)[0]
    count = min(count, (box.end - first) // (np.dtype(kind).itemsize * width))
    return np.frombuffer(data, kind, count * width, first).astype(np.int64).reshape(-1, width)


def tracks(data: bytes | memoryview) -> list[Track]:
    """The tracks of a file with their decoded sample tables. No sample is read.

    Any bytes are taken: bytes that are no container have no tracks; tracks without a full set of tables, or whose
    tables contradict themselves, have no samples; a box that ends early says nothing, and its table ends with it.
    Samples that do not lie within the file, or that would together be longer than it, are left out, so nothing that
    is allocated is larger than the file by more than a constant factor, whatever counts its boxes claim.
    """
    found: list[dict[bytes, Box]] = []
    for box in walk(data):
        if box.kind == b"trak":
            found.append({})
        elif found and b"trak" in box.path:
            found[-1].setdefault(box.kind, box)
    return [_track(data, boxes) for boxes in found]


def _track(data: bytes | memoryview, boxes: dict[bytes, Box]) -> Track:
    codec, timescale, duration = "", 0, 0
    if (b := boxes.get(b"stsd")) and b.end - b.start >= 16:
        codec = bytes(data[b.start + 12 : b.start + 16]).decode("latin-1")
    if (b := boxes.get(b"mdhd")) and b.end > b.start:
        kind, skip = (">IQ", 20) if data[b.start] else (">II", 12)
        if b.start + skip + struct.calcsize(kind) <= b.end:
            timescale, duration = struct.unpack_from(kind, data, b.start + skip)
            duration = duration if duration < 1 << 63 else 0  # all ones mean that it is not known
    none = Track(codec, timescale, duration, *(np.zeros(0, np.int64),) * 3)
    place, size = boxes.get(b"co64") or boxes.get(b"stco"), boxes.get(b"stsz")
    if not place or not size or b"stsc" not in boxes or size.end - size.start < 12:
        return none
    same, count = struct.unpack_from(">II", data, size.start + 4)
    sizes = np.full(min(count, len(data) // same), same, np.int64) if same else _numbers(data, size, 4, ">u4")[:, 0]
    sizes = sizes[np.cumsum(sizes) <= len(data)]
    chunk_at = _numbers(data, place, 0, ">u8" if place.kind == b"co64" else ">u4")[:, 0]
    runs = _numbers(data, boxes[b"stsc"], 0, ">u4", 3)
    if not len(sizes) or not len(chunk_at) or not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        return none
    per_chunk = np.minimum(runs[np.searchsorted(runs[:, 0], np.arange(1, len(chunk_at) + 1), "right") - 1, 1], len(sizes))
    # chunks up to the one that holds the last sample
    per_chunk = np.diff(np.minimum(np.append(0, np.cumsum(per_chunk)), len(sizes)))
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
    sizes = sizes[: len(chunk)]
    before = np.append(0, np.cumsum(sizes))
    first = np.append(0, np.cumsum(per_chunk))  # first sample of each chunk
    offsets = chunk_at[chunk] + before[:-1] - before[first[chunk]]
    inside = (offsets >= 0) & (offsets <= len(data) - sizes)
    keys = _numbers(data, boxes[b"stss"], 0, ">u4")[:, 0] - 1 if b"stss" in boxes else np.arange(len(sizes))
    keys = keys[(keys >= 0) & (keys < len(sizes))]
    keys = (np.cumsum(inside) - 1)[keys[inside[keys]]]
    return Track(codec, timescale, duration, offsets[inside], sizes[inside], keys)


def payload(data: bytes | memoryview, track: Track) -> bytes:
    """The samples' stored bytes in order; neighbours in the file are read as one range."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts, stops = track.offsets[np.append(0, breaks)], ends[np.append(breaks - 1, len(ends) - 1)]
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


def keyframe_ranges(track: Track) -> list[tuple[int, int]]:
    """First byte and end of every keyframe in the file."""
    at = track.offsets[track.keyframes]
    return list(zip(at.tolist(), (at + track.sizes[track.keyframes]).tolist(), strict=True))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each text's UTF-8, padded with spaces to a positive multiple of 192, as a container.
    Null text counts as empty, which is one frame of spaces. Rows are independent; other columns are not read."""

    def store(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = [(x or "").encode() for x in part.column(1).to_pylist()]
                files = [container(x + b" " * (-len(x) % FRAME if x else FRAME)) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(store, f"`{id_col}` {kind}, n_bytes long, media binary")


def media_columns(df: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of ``df`` but the media, with what the first track of each container says: ``codec``,
    ``timescale``, ``duration``, ``n_samples``, ``keyframes`` (byte ranges), and digests of the stored bytes:
    ``payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256``. Null media and bytes that are no
    container have an empty codec, no samples and the digest of no bytes; of broken boxes see :func:`tracks`. Columns named as the new ones are replaced.
    """
    new = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<first:long,end:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    names = [x.split()[0] for x in new.replace("struct<first:long,end:long>", "x").split(", ")]
    kept = [c for c in df.columns if c != media_col and c not in names]
    pairs = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pairs, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def read(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, rows = batch.slice(k, 64), []
                for value in part.column(len(kept)):
                    data = value.as_buffer() if value.is_valid else b""
                    track = next(iter(tracks(memoryview(data))), None) if len(memoryview(data)) else None
                    track = track or Track("", 0, 0, *(np.zeros(0, np.int64),) * 3)
                    stored = payload(data, track)
                    ranges = [{"first": a, "end": b} for a, b in keyframe_ranges(track)]
                    rows.append((track.codec, track.timescale, track.duration, len(track.sizes), ranges, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(memoryview(data)), hashlib.sha256(data).hexdigest()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *(pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], [*kept, *names])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), new])
    return df.select(*kept, media_col).mapInArrow(read, schema)


def feature_text(columns: DataFrame) -> DataFrame:
    """``feature``: codec, duration and keyframe byte ranges in one string (the ranges as number, first, last, digest)."""
    ranges = F.coalesce(F.transform("keyframes", lambda r: F.concat_ws("-", r["first"].cast("string"), r["end"].cast("string"))), F.array().cast("array<string>"))
    feature = F.format_string(
        "codec=%s;seconds=%.3f;samples=%d;keyframes=%d;first=%s;last=%s;ranges_crc32=%d", F.trim("codec"), F.col("duration") / F.nullif(F.col("timescale"), F.lit(0)),
        F.col("n_samples"), F.size(ranges), F.get(ranges, F.lit(0)), F.get(ranges, F.size(ranges) - 1), F.crc32(F.array_join(ranges, ",").cast("binary")),
    )
    return columns.withColumn("feature", feature)
