"""Shards cut from a Hilbert curve over several metadata dimensions.

Each dimension is quantised into ``2 ** bits`` cells of about equal numbers of rows, in
the order of its whole values, so that a cell is a range of values. Numbers are cut by
approximate quantiles; strings by the exact mass below each distinct value, from counts
that are sorted in ranges, so that values which begin alike are still told apart. Rows are sorted by their index on the Hilbert curve through the cells, and the
order is cut into runs whose counts are at most one apart (the law ``rows``). Near rows
of the curve share ranges in every dimension, so a filter on any of them skips runs.

The order is total: ties on the curve go by id, checksum and size. It is made by one
range partitioning; places follow from the partitions' counts, so that no task has
all rows.

Defined results: nulls are the lowest cell of a dimension; a null text has no bytes;
repeated rows and equal ids have places of their own; with fewer rows than shards some
shards are empty; very long texts are hashed whole; an empty table gives no rows; columns
that aren't named aren't read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, parts_for, stage, tune

BITS = 6
SHARDS = 8
#: Bytes of different strings that are sorted on the driver, at most.
FEW_BYTES = 8 << 20


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The index on the Hilbert curve of integer points (rows x dimensions), by
    undoing the rotations from the highest bit down and then the Gray code."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for k in range(dims):
            on = (x[k] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            index = index << 1 | (x[k] >> b & 1)
    return index


def in_order(value: Column, kind: T.DataType) -> Column:
    """A number in the order of the values, which aren't strings."""
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return value.cast("double")


def _offsets(df: DataFrame, part: Column, size: Column) -> tuple[DataFrame, int]:
    """(p, base): what lies before each partition, and the total; a row for each."""
    rows = sorted((r["p"], r["n"]) for r in df.groupBy(part.alias("p")).agg(F.sum(size).alias("n")).collect())
    out, total = [], 0
    for p, n in rows:
        out.append((p, total))
        total += n
    return df.sparkSession.createDataFrame(out, "p long, base long"), total


def string_cuts(values: DataFrame, n: int, few: int = BROADCAST_ROWS) -> list[str]:
    """Of a column of strings, the value at each n-th part of the rows, in order. Up to
    ``few`` different values of ``FEW_BYTES`` in all are sorted on the driver."""
    spark = values.sparkSession
    name = values.columns[0]
    counts = values.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).count()
    different, size = counts.agg(F.count("*"), F.sum(F.octet_length("value") + 16)).first()
    if not different:
        return []
    if different <= few and size <= FEW_BYTES:
        rows, upto, out = sorted(((r["value"], r["count"]) for r in counts.collect()), key=lambda r: r[0].encode()), 0, []
        total = sum(c for _, c in rows)
        for value, c in rows:
            out += [value] * ((upto + c) * n // total - upto * n // total)
            upto += c
        return out[: n - 1]
    counts = stage(counts, "values")
    ordered = counts.repartitionByRange(parts_for(spark, size), "value").sortWithinPartitions("value")
    ordered = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).cast("long")
    before, total = _offsets(ordered, part, F.col("count"))
    mass = F.sum("count").over(Window.partitionBy("p").orderBy("_at"))
    upto = ordered.withColumn("p", part).join(F.broadcast(before), "p").withColumn("upto", F.col("base") + mass)
    # how many cuts fall on a value
    crossed = upto.select("value", F.expr(f"int((upto * {n}) div {total}) - int(((upto - count) * {n}) div {total})").alias("times"), "upto").filter("times > 0")
    found = sorted((r["upto"], r["value"], r["times"]) for r in crossed.collect())
    return [v for _, v, times in found for _ in range(times)][: n - 1]


def cells(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """A cell number for each dimension, between cuts of equal depth."""
    n, cuts = 1 << bits, {}
    share = [k / n for k in range(1, n)]
    kinds = {d: df.schema[d].dataType for d in dims}
    values = {d: F.col(d) if isinstance(kinds[d], T.StringType) else in_order(F.col(d), kinds[d]) for d in dims}
    numbers = [d for d in dims if not isinstance(kinds[d], T.StringType)]
    if numbers:
        row = df.agg(*[F.percentile_approx(values[d], share, 10_000).alias(f"c{k}") for k, d in enumerate(numbers)]).first()
        cuts = {d: list(row[k] or []) for k, d in enumerate(numbers)}
    for d in dims:
        if d not in cuts:
            cuts[d] = string_cuts(df.select(d), n)

    def cell(x: Column, edges: list) -> Column:
        # cuts that fall on one value leave cells empty, so that few values spread too
        at = F.array_size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)) if edges else F.lit(0)
        return F.coalesce(at, F.lit(0)).cast("int")

    return [cell(values[d], cuts[d]) for d in dims]


def curve(df: DataFrame, dims: list[str], bits: int = BITS) -> Column:
    """The Hilbert index of each row as a long."""
    if bits * len(dims) > 62:
        raise ValueError("too many bits")

    @F.arrow_udf("long")
    def run(points: pa.Array) -> pa.Array:
        flat = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(dims))
        return pa.array(hilbert_index(flat, bits))

    return run(F.array(*cells(df, dims, bits)))


def cut_runs(df: DataFrame, dims: list[str], tie: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` (staged) with curve, shard and slot columns."""
    spark = df.sparkSession
    tune(spark)
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = sum(wide, F.lit(16 * len(df.columns)))
    indexed = stage(df.withColumn("curve", curve(df, dims, bits)), "indexed")
    parts = parts_for(spark, indexed.agg(F.sum(size)).first()[0] or 0)
    ordered = indexed.repartitionByRange(parts, "curve", *tie).sortWithinPartitions("curve", *tie)
    # this id has the number of a partition, and of a row in it
    placed = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "curve")
    part, row = F.shiftright("_at", 33).cast("long"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = _offsets(placed, part, F.lit(1))
    if not total:
        return placed.drop("_at").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    ranked = placed.withColumn("p", part).join(F.broadcast(before), "p").withColumn("_rank", F.col("base") + row)
    starts = F.array(*[F.lit(s * total // shards).cast("long") for s in range(shards)])
    shard = F.expr(f"int((_rank * {shards} + {shards - 1}) div {total})")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - F.element_at(starts, F.col("shard") + 1)).drop("p", "base", "_at", "_rank")


def manifest(placed: DataFrame, dims: list[str]) -> DataFrame:
    """The range of every dimension in every shard, for skipping."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])


@F.arrow_udf(T.LongType())
def crc32_column(texts: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the place on the
    curve of every document, by language, source and size."""
    tune(docs.sparkSession)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    slim = stage(docs.select("doc_id", size.alias("size"), crc32_column("text").alias("text_crc32"), "lang", "source"), "sizes")
    placed = cut_runs(slim, ["lang", "source", "size"], ["doc_id", "text_crc32", "size"], shards, bits)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, dims: list[str], tie: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Write whole rows as a table partitioned by shard, in curve order, and return
    its manifest."""
    placed = cut_runs(stage(docs, "rows"), dims, tie, shards, bits)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return manifest(docs.sparkSession.read.parquet(path), dims)
