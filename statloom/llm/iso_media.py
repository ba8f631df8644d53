"""ISO media containers: nested boxes, sample tables, codec, duration and keyframe byte ranges.

`write_container` stores bytes losslessly as the samples of one track, each
sample SAMPLE bytes of 8-bit units. `read_container` walks the boxes of files
of this family, decodes their sample tables (stts, stss, stsc, stsz or stz2, stco or co64)
and gives byte ranges; it never decodes a payload. Edit lists aren't applied: samples come in the order
they're stored. A file without a movie box, a fragmented one (moof: its samples aren't in these tables), one with a box or table that is cut
off or goes beyond its end, or a track without one of these boxes raises ValueError in `read_container`.

Nulls and empty texts are a payload of one padded unit. Equal texts give equal
files: no times or random values are stored. Tables may be empty; other columns are passed on,
but for those that a result of the same name replaces.
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
from pyspark.sql import types as T

from . import shared
from .textbatch import slices

SAMPLE, PER_CHUNK, KEY_EVERY, TIMESCALE = 192, 8, 16, 8000
#: Fixed values of the format: boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}
DEPTH = 32  # of boxes in boxes; the format has eight
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Track(NamedTuple):
    codec: str
    kind: str
    timescale: int
    duration: int  # in units of timescale, summed over samples
    offsets: np.ndarray  # each sample's first byte in the file
    sizes: np.ndarray
    keyframes: np.ndarray  # positions of samples that can be decoded alone


def _box(kind: bytes, *parts: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes) -> bytes:
    """A file whose only track has the payload, a positive multiple of SAMPLE, as its samples."""
    if not payload or len(payload) % SAMPLE:
        raise ValueError(f"the payload must be a positive multiple of {SAMPLE} bytes")
    n = len(payload) // SAMPLE
    chunks = -(-n // PER_CHUNK)
    length = n * SAMPLE
    rest = n - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK)] if chunks > 1 else []
    if not runs or rest != PER_CHUNK:
        runs.append((chunks, rest))
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))

    def movie(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * PER_CHUNK * SAMPLE
        wide = int(at[-1]) >= 2**32
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", a, b, 1) for a, b in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, length, 0x55C4, 0), version=1),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _box(
            b"trak",
            _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7),
            media,
        )
        head = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, length, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", head, track)

    kind = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    lead = 16 if 8 + length >= 2**32 else 8
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + length) if lead == 16 else struct.pack(">I4s", 8 + length, b"mdat")
    size = len(kind) + len(movie(0)) + lead
    moov = movie(size)
    if len(moov) != size - len(kind) - lead:  # offsets above 4 GB need the wide table
        moov = movie(len(kind) + len(moov) + lead)
    return b"".join((kind, moov, mdat, payload))


def walk(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Each box between start and end: its kind and where its body begins and ends."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        size = end - start if size == 0 else size
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} goes beyond its end")
        yield kind, body, start + size
        start += size


def _tree(data: memoryview, start: int, end: int, found: dict[bytes, tuple[int, int]], depth: int = 0) -> dict[bytes, tuple[int, int]]:
    """The first box of each kind in a box and those in it."""
    if depth > DEPTH:
        raise ValueError("boxes are nested too deeply")
    for kind, a, b in walk(data, start, end):
        found.setdefault(kind, (a, b))
        if kind in NESTED:
            _tree(data, a, b, found, depth + 1)
    return found


def _table(data: memoryview, at: tuple[int, int], kind: str, columns: int, skip: int = 4) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at[0] + skip)
    width = np.dtype(kind).itemsize * columns
    if at[0] + skip + 4 + n * width > at[1]:
        raise ValueError("a table goes beyond its box")
    return np.frombuffer(data, kind, n * columns, at[0] + skip + 4).astype(np.int64).reshape(n, columns)


def _sizes(data: memoryview, at: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Each sample's bytes: one size for all, or a table of 4 bytes (stsz) or of 4, 8 or 16 bits each (stz2)."""
    if b"stsz" in at:
        even, n = struct.unpack_from(">II", data, at[b"stsz"][0] + 4)
        return np.full(n, even, np.int64) if even else _table(data, at[b"stsz"], ">u4", 1, 8)[:, 0]
    bits, n = struct.unpack_from(">7xBI", data, at[b"stz2"][0])
    start = at[b"stz2"][0] + 12
    if bits not in (4, 8, 16) or start + -(-n * bits // 8) > at[b"stz2"][1]:
        raise ValueError("a table of sizes is wrong")
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, -(-n // 2), start)
        return np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:n].astype(np.int64)
    return np.frombuffer(data, ">u1" if bits == 8 else ">u2", n, start).astype(np.int64)


def _track(data: memoryview, start: int, end: int) -> Track:
    at = _tree(data, start, end, {})
    version = data[at[b"mdhd"][0]]
    (timescale,) = struct.unpack_from(">I", data, at[b"mdhd"][0] + (20 if version else 12))
    codec = bytes(data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
    handler = bytes(data[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]).decode("latin-1")
    sizes = _sizes(data, at)
    chunks = _table(data, at[b"co64"], ">u8", 1)[:, 0] if b"co64" in at else _table(data, at[b"stco"], ">u4", 1)[:, 0]
    runs = _table(data, at[b"stsc"], ">u4", 3)
    each = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0] - 1, len(chunks)]))
    if each.sum() != len(sizes):
        raise ValueError("the chunks don't hold all samples")
    before = np.r_[0, np.cumsum(sizes)]
    lead = np.cumsum(each) - each
    offsets = np.repeat(chunks - before[lead], each) + before[:-1]
    times = _table(data, at[b"stts"], ">u4", 2)
    keys = _table(data, at[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in at else np.arange(len(sizes))
    return Track(codec, handler, timescale, int((times[:, 0] * times[:, 1]).sum()), offsets, sizes, keys)


def read_container(content: bytes) -> list[Track]:
    """The tracks of a file, from its boxes alone."""
    data = memoryview(content)
    top = list(walk(data))
    movies = [(a, b) for kind, a, b in top if kind == b"moov"]
    if not movies:
        raise ValueError("no movie box")
    if any(kind == b"moof" for kind, *_ in top):
        raise ValueError("fragmented files aren't read")
    try:
        return [_track(data, a, b) for kind, a, b in walk(data, *movies[0]) if kind == b"trak"]
    except KeyError as missing:
        raise ValueError(f"a track has no box {missing}") from missing
    except (struct.error, IndexError) as cut:
        raise ValueError("a box is cut off") from cut


def payload_of(content: bytes, track: Track) -> bytes:
    """A track's samples, in order: neighbouring ones are read as one range."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(np.r_[True, track.offsets[1:] != ends[:-1]])
    lasts = np.r_[cuts[1:] - 1, len(ends) - 1]
    view = memoryview(content)
    return b"".join(view[a:b] for a, b in zip(track.offsets[cuts].tolist(), ends[lasts].tolist(), strict=True))


def describe(track: Track) -> str:
    """codec, kind, duration and the byte ranges of its keyframes (offset+size, comma-joined)."""
    keys = ",".join(f"{a}+{s}" for a, s in zip(track.offsets[track.keyframes].tolist(), track.sizes[track.keyframes].tolist(), strict=True))
    return f"codec={track.codec};kind={track.kind};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={keys}"


def media_columns(docs: DataFrame, text: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text as a container, reads it back and adds what the boxes tell.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature and, if asked for, media (the file).
    """
    new = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType())]
    new += [("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    new += [("media", T.BinaryType())] * keep_media
    others = shared.others(docs, (k for k, _ in new), text)
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(*x) for x in new])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = []
            for value in batch[text].cast(pa.large_binary()):
                raw = value.as_py() or b""
                size = max(1, -(-len(raw) // SAMPLE)) * SAMPLE
                media = write_container(raw.ljust(size, b" "))
                track = read_container(media)[0]
                back = payload_of(media, track)
                stored = (len(media), hashlib.sha256(media).hexdigest(), describe(track), media)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), *stored)[: len(new)])
            made = zip(*rows, strict=True) if rows else [[]] * len(new)
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in others] + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=schema.names
            )

    return docs.select(*others, text).mapInArrow(run, schema)
