"""Bounded-space online best-fit packing of token sequences.

Documents are tokenised once into pieces of at most ``capacity`` ids; only longer
documents are cut. Whole pieces fill a sequence by themselves. The others are dealt
out, by their place in the staged table and so evenly however many are equal, over
tasks of about ``TASK_PIECES`` pieces, and each task packs its own:
a fixed number of bins is open, a bitset has one bit for each amount of free space
that some open bin has, and a piece goes where the least space would be left. When
no open bin has room and all are open, the fullest closes first.

Pieces reach the bins in windows, longest first, which lets short pieces fill what
long ones leave.

Defined results: a null or empty text is one piece that holds the end id only;
repeated rows are packed as often as they occur; rows that tie in length go in the
order in which they were dealt; very long texts become many pieces; an empty table gives
no rows; other columns of the table aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, tune
from .tokens import encoder, tokenizer_path

CAPACITY = 2048
OPEN_BINS = 4096
WINDOW = 8192
TASK_PIECES = 65_536
#: Chunks that a worker keeps: fewer than by default, as packing often shares its
#: executors' memory with other stages.
KEPT = 300_000
END_ID = 0


class BestFit:
    """The open bins of one task, keyed by free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits = self.open = self.made = 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        taken = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        return taken

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it where a piece goes."""
        roomy = self.bits >> length
        if roomy:
            space = length + (roomy & -roomy).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            chosen, space = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = space - length
        self.free.setdefault(left, []).append(chosen)
        self.bits |= 1 << left
        return chosen, self.capacity - space


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes the remainder."""
    first = n_ids % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document, without the ids themselves."""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, KEPT)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids += end
                out += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            if out:
                cols = list(zip(*out))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def place(rows: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, window: int = WINDOW, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Add sequence_id and offset to a staged table of pieces."""
    whole = rows.filter(F.col("length") >= capacity)
    part = rows.filter(F.col("length") < capacity)
    tasks = max(1, -(-part.count() // task_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = BestFit(capacity, open_bins), (2 * TaskContext.get().partitionId() + 1) << 40
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            length = table.column("length").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for i in np.argsort(-length, kind="stable").tolist():
                seq[i], off[i] = bins.put(int(length[i]))
            return pa.record_batch([*table.columns[:5], pa.array(seq + base), pa.array(off)], names=[*table.schema.names[:5], "sequence_id", "offset"])

        for batch in batches:
            while batch.num_rows:
                room = window - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == window:
                    yield flush()
        if held:
            yield flush()

    dealt = part.withColumn("_deal", F.xxhash64(F.monotonically_increasing_id()))
    packed = dealt.repartition(tasks, "_deal").sortWithinPartitions("_deal").mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
    # ids of full pieces are negative, those of bins aren't
    alone = whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, **settings) -> DataFrame:
    """Pack ``docs`` (doc_id, text): one row for each piece, with its place."""
    found = stage(pieces(docs, path or tokenizer_path(), capacity), "pieces")
    return place(found, capacity, **settings)
