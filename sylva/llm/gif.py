"""GIF media columns: timed frames, composed canvases and colour histograms.

``decode`` reads LZW code streams, global and local palettes, interlacing, the
four disposal rules and transparent indices. ``encode_payload`` stores arbitrary
bytes losslessly as 8-bit samples: rows of 64 grey pixels, in frames of at most
``FRAME_ROWS`` rows, with the number of bytes in a comment block. ``frames`` gives the
composed canvases, ``media_columns`` a row for each file, with its timed frames and
their histograms as columns.

Defined results: a null or empty text is one row of 64 zero samples; a very long text
has as many frames as it needs; equal texts give equal media; media that can't be read,
or whose canvas or a frame has more than ``MAX_PIXELS`` pixels (what a worker composes
in memory), give one row whose ``error`` says why and no frames; repeated rows are kept
as often as they occur; ids that tie are rows of their own; an empty table gives no rows;
other columns of the table aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, tune

WIDTH = 64
FRAME_ROWS = 1024
DELAY_CS = 10
MAX_CODES = 4096
#: The largest canvas or frame that is composed: 64 MB as RGBA.
MAX_PIXELS = 1 << 24


@cache
def _widths(base: int, n: int) -> np.ndarray:
    """Bits of the n codes that follow a clear code; base is that code."""
    size = np.maximum(np.arange(n) - 1, 0) + base + 2
    bits = np.full(n, base.bit_length(), np.int64)
    for b in range(base.bit_length(), 12):
        bits[size >= 1 << b] = b + 1
    return bits


@cache
def _ends(base: int) -> np.ndarray:
    return np.cumsum(_widths(base, MAX_CODES))


_FULL = np.full(MAX_CODES, 12, np.int64)
_FULL_ENDS = np.cumsum(_FULL)

#: Codes from one clear code to the next when an 8-bit encoder fills its table.
_RUN = MAX_CODES - 256
_RUN_BITS = _widths(256, _RUN)


def lzw_encode(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples."""
    codes, at, n = [256], 1, len(data)
    prefix = data[0]
    while at < n:
        table: dict[int, int] = {}
        get, add = table.get, codes.append
        free = 258
        for c in memoryview(data)[at:]:
            at += 1
            code = get(key := prefix << 8 | c)
            if code is not None:
                prefix = code
                continue
            add(prefix)
            prefix = c
            if free == MAX_CODES:
                add(256)
                break
            table[key] = free
            free += 1
    codes += (prefix, 257)
    value = np.array(codes, np.int64)
    bits = np.concatenate([[9], np.tile(_RUN_BITS, -(-len(codes) // _RUN))[: len(codes) - 1]])
    end = np.cumsum(bits)
    start = end - bits
    value <<= start & 7
    at, n = start >> 3, int(end[-1] + 7) >> 3
    out = np.bincount(at, value & 255, n + 2) + np.bincount(at + 1, value >> 8 & 255, n + 2) + np.bincount(at + 2, value >> 16, n + 2)
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, min_bits: int, size: int) -> bytes:
    """At most ``size`` samples of a code stream; ValueError if it is broken."""
    clear = 1 << min_bits
    buf = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    total = 8 * len(data)
    roots = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, made = 0, 0
    table, prev, fresh = roots[:], b"", True
    while made < size:
        bits, end = (_widths(clear, MAX_CODES), _ends(clear)) if fresh else (_FULL, _FULL_ENDS)
        keep = int(np.searchsorted(end, total - at, "right"))
        if not keep:
            break
        bits, end = bits[:keep], end[:keep] + at
        start = end - bits
        byte = start >> 3
        codes = (buf[byte] | buf[byte + 1] << 8 | buf[byte + 2] << 16) >> (start & 7) & ((1 << bits) - 1)
        stop = np.flatnonzero((codes >> 1) == clear >> 1)
        n = int(stop[0]) if len(stop) else keep
        done, run = len(out), codes[:n].tolist()
        if run and not prev:
            first = run.pop(0)
            if first >= clear:
                raise ValueError("first code is not a root")
            prev = table[first]
            out.append(prev)
        room = MAX_CODES - len(table)
        add, emit = table.append, out.append
        for code in run[:room]:
            try:
                entry = table[code]
                add(prev + entry[:1])
            except IndexError:
                if code > len(table):
                    raise ValueError("code beyond the table") from None
                entry = prev + prev[:1]
                add(entry)
            emit(entry)
            prev = entry
        if full := run[room:]:
            out += map(table.__getitem__, full)
            prev = out[-1]
        made += sum(map(len, out[done:]))
        if not len(stop):
            at, fresh = int(end[-1]), False
            continue
        if codes[n] == clear + 1:
            break
        at, table, prev, fresh = int(end[n]), roots[:], b"", True
    found = b"".join(out)[:size]
    if len(found) < size:
        raise ValueError("code stream ends early")
    return found


_GREY = bytes(i for i in range(256) for _ in range(3))


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((min(255, len(data) - i),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_payload(raw: bytes) -> bytes:
    """A GIF whose samples are ``raw`` and zeros up to a positive multiple of 64."""
    rows = max(1, -(-len(raw) // WIDTH))
    payload = raw.ljust(rows * WIDTH, b"\0")
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY, b"\x21\xfe", _blocks(b"bytes=%d" % len(raw))]
    for first in range(0, rows, FRAME_ROWS):
        n = min(FRAME_ROWS, rows - first)
        out += (b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, n, 0), b"\x08")
        out.append(_blocks(lzw_encode(payload[first * WIDTH : (first + n) * WIDTH])))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray  # rows x columns
    palette: np.ndarray  # entries x 3
    delay_cs: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray | None = None  # rows x columns x 4, as shown


@dataclass
class Gif:
    width: int
    height: int
    background: int
    frames: list[Frame]
    comments: list[bytes]


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(0, rows, 8), np.arange(4, rows, 8), np.arange(2, rows, 4), np.arange(1, rows, 2)])


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def decode(data: bytes, compose: bool = True) -> Gif:
    """All frames; with ``compose`` also the canvas that each of them shows."""
    try:
        return _decode(data, compose)
    except (IndexError, struct.error) as e:
        raise ValueError("file ends early") from e


def _decode(data: bytes, compose: bool) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    gif = Gif(width, height, background, [], [])
    if width * height > MAX_PIXELS:
        raise ValueError(f"canvas of {width} x {height} pixels is too large")
    canvas = np.zeros((height, width, 4), np.uint8) if compose else None
    delay, disposal, transparent = 0, 0, None
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            elif label == 0xFE:
                gif.comments.append(body)
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        if w * h > MAX_PIXELS:
            raise ValueError(f"frame of {w} x {h} pixels is too large")
        palette = common
        if flags & 0x80:
            palette, at = _palette(data, at, flags)
        if palette is None:
            raise ValueError("no palette")
        min_bits = data[at]
        if not 1 <= min_bits <= 8:
            raise ValueError("bad code size")
        body, at = _sub_blocks(data, at + 1)
        indices = np.frombuffer(lzw_decode(body, min_bits, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            straight = np.empty_like(indices)
            straight[_interlaced(h)] = indices
            indices = straight
        frame = Frame(left, top, indices, palette, delay, disposal, transparent)
        if canvas is not None:
            before = canvas.copy() if disposal == 3 else None
            seen = indices[: max(0, height - top), : max(0, width - left)]
            spot = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
            colours = np.full((256, 4), 255, np.uint8)
            colours[:, :3] = 0
            colours[: len(palette), :3] = palette
            if transparent is None:
                spot[:] = colours[seen]
            else:
                shown = seen != transparent
                spot[shown] = colours[seen[shown]]
            frame.canvas = canvas.copy()
            if disposal == 2:
                spot[:] = 0
            elif before is not None:
                canvas = before
        gif.frames.append(frame)
        delay, disposal, transparent = 0, 0, None
    return gif


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of 64 colours (2 bits each of red, green and blue) of opaque pixels."""
    flat = pixels.reshape(-1, 4)
    flat = flat[flat[:, 3] > 0]
    code = (flat[:, 0] >> 6).astype(np.int64) << 4 | (flat[:, 1] >> 6) << 2 | flat[:, 2] >> 6
    return np.bincount(code, minlength=64)


def brightness(pixels: np.ndarray) -> np.ndarray:
    """Counts of 16 levels of the mean of red, green and blue of opaque pixels."""
    flat = pixels.reshape(-1, 4)
    flat = flat[flat[:, 3] > 0]
    level = (flat[:, 0].astype(np.int64) + flat[:, 1] + flat[:, 2]) // 48
    return np.bincount(level, minlength=16)


def _place(f: Frame) -> np.ndarray:
    """What a frame's own place on the canvas shows."""
    return f.canvas[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1]]


def _timed(gif: Gif) -> Iterator[dict]:
    """The columns of each frame, in order: the histogram is of the whole canvas, the
    brightness of the frame's place."""
    clock = 0
    for k, f in enumerate(gif.frames):
        yield {"frame": k, "start_ms": clock, "delay_ms": 10 * f.delay_cs, "left": f.left, "top": f.top, "width": f.indices.shape[1], "height": f.indices.shape[0], "disposal": f.disposal, "transparent": f.transparent, "histogram": histogram(f.canvas).tolist(), "brightness": brightness(_place(f)).tolist()}
        clock += 10 * f.delay_cs


_TIMED = [("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("histogram", pa.list_(pa.int64())), ("brightness", pa.list_(pa.int64()))]
_TIMED_DDL = "frame{0}int, start_ms{0}long, delay_ms{0}long, left{0}int, top{0}int, width{0}int, height{0}int, disposal{0}int, transparent{0}int, histogram{0}array<long>, brightness{0}array<long>"
FRAMES = f"id long, {_TIMED_DDL.format(' ')}, canvas_width int, canvas_height int, rgba binary, error string"


def frames(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each frame: its time and place, its histograms, its composed canvas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), *_TIMED, ("canvas_width", pa.int32()), ("canvas_height", pa.int32()), ("rgba", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    gif = decode(data or b"")
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"id": name, "error": str(e)}], schema)
                    continue
                for row, f in zip(_timed(gif), gif.frames):
                    row |= {"id": name, "canvas_width": gif.width, "canvas_height": gif.height, "rgba": f.canvas.tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema)

    tune(media.sparkSession)
    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(run, FRAMES)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A staged table of (id, media): every whole text as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([encode_payload(x or b"") for x in raw], pa.binary())], names=["id", "media"])

    tune(docs.sparkSession)
    return stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, media binary"), "media")


COLUMNS = f"id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<struct<{_TIMED_DDL.format(':')}>>, error string"


def media_columns(media: DataFrame) -> DataFrame:
    """A row for each file of a table (id, media), read back through the decoder: its
    timed frames with their histograms, and digests of the samples they hold (the grey
    of each frame's place on the canvas, in order)."""

    def one(name: int | None, data: bytes) -> dict:
        try:
            gif = decode(data or b"")
        except ValueError as e:
            return {"id": name, "error": str(e)}
        grey = b"".join(_place(f)[:, :, 0].tobytes() for f in gif.frames)
        said = next((c for c in gif.comments if c.startswith(b"bytes=") and c[6:].isdigit()), b"bytes=%d" % len(grey))
        return {"id": name, "n_bytes": int(said[6:]), "payload_bytes": len(grey), "payload_sha256": hashlib.sha256(grey).hexdigest(), "tail_crc32": zlib.crc32(grey[-64:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "frames": list(_timed(gif))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct(_TIMED)), pa.string())
        schema = pa.schema(list(zip(("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "error"), kinds)))
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([one(*row) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], schema)

    tune(media.sparkSession)
    return stage(media.select("id", "media").mapInArrow(run, COLUMNS), "frames")


def digests(columns: DataFrame) -> DataFrame:
    """The digest of each row of ``media_columns``. feature: the number of frames, then
    how many of their pixels have each of 16 levels of brightness."""
    zero = F.array_repeat(F.lit(0).cast("long"), 16)
    levels = F.aggregate("frames", zero, lambda acc, f: F.zip_with(acc, f["brightness"], lambda a, b: a + b))
    feature = F.concat(F.size("frames").cast("string"), F.lit(":"), F.array_join(levels.cast("array<string>"), ","))
    return columns.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
