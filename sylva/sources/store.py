"""Tables kept as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths given out in this process and not swept yet, in order.
_given: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where it names none and everything
    runs in one process (tests) a temporary folder is made, and recorded in the
    session's settings; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sylva.store.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="sylva-")
        spark.conf.set("spark.sylva.store.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _given.append(f"{shared_dir(spark)}/sylva-{name}-{uuid.uuid4().hex}")
    return _given[-1]


def mark() -> int:
    """A place in the list of stored paths, for ``sweep``."""
    return len(_given)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Delete what this process stored since a mark, when no result that reads it is
    needed any more; ``keep`` names paths that stay. Gives the number of paths."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    gone = [p for p in _given[since:] if p not in keep]
    _given[since:] = [p for p in _given[since:] if p in keep]
    for at in gone:
        path = jvm.org.apache.hadoop.fs.Path(at)
        n += path.getFileSystem(conf).delete(path, True)
    return n


def save(df: DataFrame, path: str) -> None:
    """In order of documents within files, so that ranges of doc_id skip row groups."""
    keys = [c for c in ("doc_id", "pre", "seq") if c in df.columns]
    (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(path)


def load(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).parquet(path)


def roundtrip(df: DataFrame, name: str) -> DataFrame:
    """Stored as it comes, and read from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return load(df, path)
