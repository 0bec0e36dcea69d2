"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import ship
from sylva.sources import store

#: Arrow batches are bounded by rows and bytes, so that very long texts don't
#: pile up in a Python worker.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

#: A small table may be broadcast when a count has shown that it has no more rows.
BROADCAST_ROWS = 20_000


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; workers can import the package."""
    ship(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    so that a lost executor repeats nothing before this point."""
    spark = df.sparkSession
    path = store.shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables staged inside are deleted at the end, but for those put into the list."""
    since, kept = store.mark(), []
    yield kept
    store.sweep(spark, since, tuple(t._staged_at for t in kept))


#: Bytes of a shuffled partition where the count of partitions is chosen here, and of
#: one below which more partitions don't help.
PART_BYTES, LEAST_BYTES = 128 << 20, 8 << 20


def parts_for(spark: SparkSession, size: int, busy: bool = False) -> int:
    """Partitions for so many bytes: as many as the session asks for, fewer where they
    would be tiny (not if tasks are ``busy`` for their size), more where they would be
    large: an explicit count isn't split by adaptive execution."""
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, asked if busy else min(asked, -(-size // LEAST_BYTES)), -(-size // PART_BYTES))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a (staged) table for broadcast after counting it; else leave the
    join to shuffle, where adaptive execution splits skewed partitions."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
