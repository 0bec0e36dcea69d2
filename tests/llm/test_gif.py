import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm import gif

from .conftest import ODD


def payload(t):
    raw = (t or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(1, 60))
def test_codes_round_trip(part, times):
    data = part * times
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_long_streams_round_trip():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, 90_000).astype(np.uint8).tobytes(), b"a" * 500_000, rng.integers(0, 3, 200_000).astype(np.uint8).tobytes()):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def pack(codes, base):
    """Bits of codes as a plain encoder writes them, clear codes optional."""
    out = n = 0
    free, width, last = base + 2, base.bit_length(), None
    for c in codes:
        out |= c << n
        n += width
        if c == base:
            free, width, last = base + 2, base.bit_length(), None
        else:
            if last is not None and free < 4096:
                free += 1
                if free == 1 << width and width < 12:
                    width += 1
            last = c
    return out.to_bytes((n + 7) // 8, "little")


def test_small_alphabets_and_full_tables():
    assert gif.lzw_decode(pack([4, 1, 6, 6, 2, 9, 9, 5], 4), 2, 10) == bytes([1] * 5 + [2] * 5)
    # a table that stays full without a clear code
    literal = [256] + [k % 251 for k in range(6000)] + [257]
    assert gif.lzw_decode(pack(literal, 256), 8, 6000) == bytes(k % 251 for k in range(6000))
    with pytest.raises(ValueError):
        gif.lzw_decode(pack([4, 1, 7, 5], 4), 2, 9)
    with pytest.raises(ValueError):
        gif.lzw_decode(pack([4, 1, 5], 4), 2, 9)


def image(left, top, rows, disposal, transparent=None, delay=7, palette=None, interlaced=False):
    h, w = len(rows), len(rows[0])
    order = gif._interlaced(h) if interlaced else range(h)
    flat = [rows[r][c] for r in order for c in range(w)]
    out = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x81 if palette else 0) | (0x40 if interlaced else 0)) + (palette or b"")
    return out + b"\x02" + gif._blocks(pack([4, *flat, 5], 4))


RED, GREEN, BLUE, BLACK = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
COMMON = bytes(x for c in (BLACK, RED, GREEN, BLUE) for x in c)


def film(*images, w=2, h=2):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + COMMON + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00" + b"".join(images) + b"\x3b"


def colours(canvas):
    return [tuple(p[:3]) if p[3] else None for p in canvas.reshape(-1, 4).tolist()]


def test_disposal_and_transparency():
    g = gif.decode(film(image(0, 0, [[1, 1], [1, 1]], 1), image(0, 0, [[2, 0], [0, 2]], 2, transparent=0), image(1, 0, [[3]], 3), image(0, 1, [[2]], 0, palette=COMMON[::-1])))
    shown = [colours(f.canvas) for f in g.frames]
    assert shown[0] == [RED] * 4
    assert shown[1] == [GREEN, RED, RED, GREEN]
    assert shown[2] == [None, BLUE, None, None]  # the second frame's place is cleared
    assert shown[3] == [None, None, tuple(COMMON[::-1][6:9]), None]  # the third is undone
    assert [f.delay_cs for f in g.frames] == [7] * 4


def test_interlacing_and_pieces_beyond_the_canvas():
    rows = [[k % 4] * 2 for k in range(11)]
    assert gif.decode(film(image(0, 0, rows, 0, interlaced=True), w=2, h=11)).frames[0].indices.tolist() == rows
    g = gif.decode(film(image(1, 1, [[1, 2], [3, 1]], 0)))
    assert colours(g.frames[0].canvas) == [None, None, None, RED]


def test_frames_table(spark):
    good = film(image(0, 0, [[1, 1], [1, 1]], 1, delay=3), image(0, 0, [[2, 0], [0, 2]], 1, transparent=0, delay=9))
    table = spark.createDataFrame([(1, good), (2, b"no"), (3, None), (4, good[:40]), (5, good[:-20])], "doc_id long, media binary")
    rows = gif.frames(table, "doc_id", "media").collect()
    first = sorted((r for r in rows if r.id == 1), key=lambda r: r.frame)
    assert [(r.start_ms, r.delay_ms, r.transparent) for r in first] == [(0, 30, None), (30, 90, 0)]
    assert first[1].histogram[3 << 4] == 2 and first[1].histogram[3 << 2] == 2 and sum(first[1].histogram) == 4
    assert all(r.error and r.frame is None for r in rows if r.id != 1) and {r.id for r in rows} == {1, 2, 3, 4, 5}
    cols = {r.id: r for r in gif.media_columns(table.withColumnRenamed("doc_id", "id")).collect()}
    assert [f.start_ms for f in cols[1].frames] == [0, 30] and [list(f.histogram) for f in cols[1].frames] == [list(r.histogram) for r in first]
    assert all(cols[k].error and cols[k].frames is None for k in (2, 3, 4, 5))


def test_canvases_beyond_memory_are_refused(spark):
    """A few bytes may declare 17 GB of pixels."""
    head = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x81, 0, 0) + COMMON
    huge = film(image(0, 0, [[1, 1], [1, 1]], 1), w=65535, h=65535)
    frame = film(b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02" + gif._blocks(pack([4, 1, 5], 4)))
    table = spark.createDataFrame([(1, huge), (2, head + b"\x3b"), (3, frame)], "id long, media binary")
    for rows in (gif.frames(table, "id", "media").collect(), gif.media_columns(table).collect()):
        assert sorted((r.id, "too large" in r.error) for r in rows) == [(1, True), (2, True), (3, True)]


def test_digests(spark, odd, empty):
    rows = sorted(map(tuple, gif.digests(gif.media_columns(gif.store(odd))).collect()), key=str)
    want = []
    for i, t in ODD:
        p, n = payload(t), len((t or "").encode())
        media = gif.encode_payload((t or "").encode())
        levels = np.bincount(np.frombuffer(p, np.uint8) >> 4, minlength=16)
        n_frames = -(-len(p) // (64 * gif.FRAME_ROWS))
        want.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{n_frames}:" + ",".join(map(str, levels))))
    assert rows == sorted(want, key=str)
    assert gif.digests(gif.media_columns(gif.store(empty))).count() == 0
