"""Token files of directly addressable codes.

A segment holds the ids of consecutive documents. Level 0 has the low 8 bits of
every id and a bitmap that says which ids go on; level 1 has the next 8 bits of
those only, and so on. A rank directory has the count of set bits before each
block of 512, so that an id's place in the next level is one directory entry and
one popcount away: any token, and any range of them, is read without decoding others.

    segment: magic "DAC2" | u32 levels | u64 ids | u64 documents
             for each level: u64 entries, places of chunks, bitmap, ranks (0: none)
             u64 place of the documents
             for each level: chunks | bitmap | u32 ranks (none at the last)
             documents: i64 ids | u8 null flags | u64 ends

Segments lie uncompressed, one after another, in files that tasks write to the folder
shared by all (any that Arrow's file systems reach). A manifest, which Spark writes and
commits, has a row for each segment: its file, its place there, and how many ids come
before it. Each attempt at a task writes a file of its own name, and only what the
manifest names counts, so a lost executor leaves nothing that is read.

Documents are tokenised first, and their codes are what is dealt out and sorted: over
ranges of ids between approximate quantiles and, where one id fills several ranges, of
the codes' hashes. So texts are read and tokenised once.

Defined results: a null or empty text holds the end id only; null ids come first;
repeated rows are stored as often as they occur, equal ids in the order of their codes'
hashes; a very long text may fill a segment by itself; an empty table gives no
segments; other columns aren't read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.sources.store import shared_path

from .common import parts_for, stage, tune
from .tokens import encoder, tokenizer_path

BLOCK = 512
#: A segment is closed at the first document end after so many ids.
SEGMENT_IDS = 1 << 18
END_ID = 0
#: Chunks that a worker keeps (about 200 bytes each): it does nothing else here.
KEPT = 1_200_000
_HEAD = struct.Struct("<4sIQQ")
_LEVEL = struct.Struct("<QQQQ")
_MOST_LEVELS = 4


def encode_segment(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    levels, rest = [], ids.astype("<u4", copy=False)
    while True:
        chunk, more = rest.astype(np.uint8), rest > 255
        if not more.any():
            levels.append((len(rest), chunk.tobytes(), b"", b""))
            break
        bitmap = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(np.bitwise_count(bitmap), np.arange(0, len(bitmap), BLOCK // 8), dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4")
        levels.append((len(rest), chunk.tobytes(), bitmap.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
    at, places = _HEAD.size + _LEVEL.size * len(levels) + 8, []
    for n, *parts in levels:
        own = []
        for p in parts:
            own.append(at if p else 0)
            at += len(p)
        places.append(_LEVEL.pack(n, *own))
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.cumsum(lengths, dtype=np.int64).astype("<u8").tobytes()
    return b"".join([_HEAD.pack(b"DAC2", len(levels), len(ids), len(doc_ids)), *places, struct.pack("<Q", at), *(p for _, *parts in levels for p in parts), docs])


class Segment:
    """A stored segment. ``read(place, n)`` gives n of its bytes, from memory or from a
    file: nothing is read but what a call needs."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = bytes(read(0, _HEAD.size + _LEVEL.size * _MOST_LEVELS + 8))
        magic, levels, self.n_ids, self.n_docs = _HEAD.unpack_from(head)
        if magic != b"DAC2":
            raise ValueError("not a segment")
        self.levels = [_LEVEL.unpack_from(head, _HEAD.size + k * _LEVEL.size) for k in range(levels)]
        (self.docs_at,) = struct.unpack_from("<Q", head, _HEAD.size + levels * _LEVEL.size)

    @classmethod
    def of(cls, data: bytes) -> Segment:
        view = memoryview(data)
        return cls(lambda at, n: view[at : at + n])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids, and where each document ends."""
        raw, n = self.read(self.docs_at, 17 * self.n_docs), self.n_docs
        ids, null = np.frombuffer(raw, "<i8", n).tolist(), np.frombuffer(raw, np.uint8, n, 8 * n).tolist()
        return [None if x else i for i, x in zip(ids, null)], np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)

    def _rank(self, level: tuple, i: int) -> int:
        """Set bits before bit i: one directory entry and the popcount of part of a block."""
        _, _, bitmap, ranks = level
        block = i // BLOCK
        first = block * (BLOCK // 8)
        bits = np.frombuffer(self.read(bitmap + first, (i >> 3) - first + 1), np.uint8)
        below = int(np.bitwise_count(bits[: (i >> 3) - first]).sum())
        if i & 7:
            below += (int(bits[-1]) & ((1 << (i & 7)) - 1)).bit_count()
        return struct.unpack("<I", self.read(ranks + 4 * block, 4))[0] + below

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            _, chunks, bitmap, _ = level
            value |= self.read(chunks + i, 1)[0] << 8 * k
            if not bitmap or not self.read(bitmap + (i >> 3), 1)[0] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b - 1. On each level they lie together: the rank of a
        says where."""
        out = where = None
        for k, level in enumerate(self.levels):
            _, chunks, bitmap, _ = level
            chunk = np.frombuffer(self.read(chunks + a, b - a), np.uint8).astype("<u4")
            if out is None:
                out = chunk
            else:
                out[where] |= chunk << np.uint32(8 * k)
            if not bitmap or a == b:
                break
            first = a >> 3
            bits = np.unpackbits(np.frombuffer(self.read(bitmap + first, (b + 7 >> 3) - first), np.uint8), bitorder="little")
            on = np.flatnonzero(bits[a - 8 * first : b - 8 * first])
            if not len(on):
                break
            where = on if where is None else where[on]
            a = self._rank(level, a)
            b = a + len(on)
        return out


CODES = "part int, doc_id long, n long, tie long, codes binary"
_LOWEST = -(1 << 63)


def part_of(ids: list[int | None], ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range that each id is in: how many bounds are below it. An id that is several
    bounds has their ranges, shared out by its ties; null comes before all."""
    flat = np.array([_LOWEST if i is None else i for i in ids], np.int64)
    low, high = np.searchsorted(bounds, flat, "left"), np.searchsorted(bounds, flat, "right")
    share = (ties.astype(np.float64) + 2.0**63) / 2.0**64
    spread = low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)
    out = np.where(high - low > 1, spread, low)
    # the lowest of all ids comes behind null ones
    lowest = np.array([i == _LOWEST for i in ids], bool)
    return np.where(lowest, high, out)


def tokenised(docs: DataFrame, path: str, bounds: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each document, two bytes each where they all fit, and its range."""
    end, cuts = END_ID.to_bytes(4, "little"), np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, KEPT)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [np.frombuffer(raw + end, "<u4") for raw in enc.encode(batch.column(1).to_pylist())]
            codes = [(x.astype("<u2") if x.max() < 1 << 16 else x).tobytes() for x in found]
            ties = np.array([zlib.crc32(c) << 32 | zlib.adler32(c) for c in codes], np.uint64).view(np.int64)
            part = part_of(batch.column(0).to_pylist(), ties, cuts)
            yield pa.record_batch([pa.array(part, pa.int32()), batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(ties), pa.array(codes, pa.binary())], names=["part", "doc_id", "n", "tie", "codes"])

    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, CODES)


MANIFEST = "part int, segment_no int, first long, n_ids long, n_docs long, file string, at long, bytes long"


def write_tokens(docs: DataFrame, to: str | None = None, path: str | None = None, n_parts: int | None = None, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in ascending id order as token files below ``to`` (by default in the
    shared folder), and give the manifest. ``first`` counts the ids of the same part
    before a segment; parts follow each other."""
    spark = docs.sparkSession
    # ids take about half the bytes of their texts
    n_parts = n_parts or parts_for(spark, (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // 2)
    share, exact = [k / n_parts for k in range(1, n_parts)], max(10_000, 20 * n_parts)
    lowest = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST))
    bounds = docs.agg(F.percentile_approx(lowest, share, exact)).first()[0] if share else []
    codes = tokenised(docs, path or tokenizer_path(), sorted(bounds or []), id_col, text_col)
    to = to or shared_path(spark, "dac")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, first, at = TaskContext.get().partitionId(), 0, 0, 0
        store = out = None
        file = f"{to}/part-{part:06d}-{uuid.uuid4().hex}.dac"
        held: list[np.ndarray] = []
        names: list[int | None] = []
        rows: list[tuple] = []
        n = 0

        def close() -> None:
            nonlocal number, first, at, n, store, out
            if out is None:
                store, where = fs.FileSystem.from_uri(file)
                store.create_dir(where.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(where)
            data = encode_segment(np.concatenate(held), names, [len(x) for x in held])
            out.write(data)
            rows.append((part, number, first, n, len(names), file, at, len(data)))
            number, first, at, n = number + 1, first + n, at + len(data), 0
            held.clear()
            names.clear()

        for batch in batches:
            for doc, size, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                held.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * size else "<u4").astype("<u4"))
                names.append(doc)
                n += size
                if n >= segment_ids:
                    close()
        if names:
            close()
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in MANIFEST.split(", ")])

    ordered = codes.repartitionById(n_parts, "part").sortWithinPartitions("doc_id", "tie")
    return stage(ordered.mapInArrow(run, MANIFEST), "manifest")


def _files() -> Callable[[str], object]:
    """Opens files, the last one only once."""
    opened: list = [None, None]

    def get(file: str):
        if opened[0] != file:
            store, where = fs.FileSystem.from_uri(file)
            opened[:] = file, store.open_input_file(where)
        return opened[1]

    return get


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files: its ids are
    addressed by its place, through the rank directories."""
    tune(manifest.sparkSession)
    # as many rows as write_tokens had parts, one for each 8 MB of codes at most
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = manifest.join(before, "part").select((F.col("before") + F.col("first")).alias("start"), "file", "at", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _files()
        for batch in batches:
            for start, file, at, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                seg = Segment.of(get(file).read_at(size, at))
                names, ends = seg.documents()
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(seg.ids(a, b)) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def directory(manifest: DataFrame) -> DataFrame:
    """doc_id, file, at, begin, n of every document; only heads and lists of documents
    are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _files()
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, ends = Segment(lambda place, n, at=at, file=file: get(file).read_at(n, at + place)).documents()
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                k = len(names)
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array([file] * k), pa.array([at] * k, pa.int64()), pa.array(begins), pa.array(ends - begins)], names=["doc_id", "file", "at", "begin", "n"])

    tune(manifest.sparkSession)
    return manifest.select("file", "at").mapInArrow(run, "doc_id long, file string, at long, begin long, n long")


def tokens_at(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, i, id) for rows (doc_id, i) of ``wanted``: the i-th id of a document, null
    where it has fewer; documents that aren't there give no row. A token costs a few
    short reads of its file, whatever the size of the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, seen, seg = _files(), None, None
        for batch in batches:
            out = []
            for file, at, place in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if place is None:
                    out.append(None)
                    continue
                if seen != (file, at):
                    seen, seg = (file, at), Segment(lambda p, n, at=at, file=file: get(file).read_at(n, at + p))
                out.append(seg[place])
            yield pa.record_batch([batch.column(3), batch.column(4), pa.array(out, pa.int64())], names=["doc_id", "i", "id"])

    place = F.when((F.col("i") >= 0) & (F.col("i") < F.col("n")), F.col("begin") + F.col("i"))
    found = wanted.select(F.col("doc_id").cast("long"), F.col("i").cast("long")).join(directory(manifest), "doc_id")
    rows = found.select("file", "at", place.alias("place"), "doc_id", "i").sortWithinPartitions("file", "at", "place")
    tune(manifest.sparkSession)
    return rows.mapInArrow(run, "doc_id long, i long, id long")
