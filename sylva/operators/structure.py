"""Ancestors and descendants by equality joins.

A path (positions from the root) names a node, and those of its ancestors are its
prefixes. So a node below another shares a key with it: the hash of the upper one's
path is among the hashes of the prefixes of the lower one's. A join on document and
key makes one row for each pair that is asked for, and none for the others; ranks,
compared after it, decide where hashes are equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(path: str | Column = "path") -> Column:
    """What names a node within its document."""
    return F.xxhash64(path)


def keys_above(path: str | Column = "path", own: bool = False) -> Column:
    """The keys of a node's ancestors, from the root on; with ``own``, its own behind."""
    at = F.col(path) if isinstance(path, str) else path
    last = F.size(at) if own else F.size(at) - 1
    keys = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.xxhash64(F.slice(at, 1, k)))
    return keys if own else F.when(last >= 0, keys).otherwise(F.array().cast("array<bigint>"))


def with_path(of: DataFrame, nodes: DataFrame) -> DataFrame:
    """``of`` (doc_id, pre, ...) with the paths of its nodes."""
    if "path" in of.columns:
        return of
    return of.join(wide(nodes.select("doc_id", "pre", "path")), ["doc_id", "pre"])


def wide(rows: DataFrame) -> DataFrame:
    """For a join of two tables that grow with the input: neither goes through the
    driver. Spark takes the size of a stored table from its compressed files, and that of
    exploded rows from the rows before, so that large ones look small enough to
    broadcast."""
    return rows.hint("merge")


def pairs(lower: DataFrame, upper: DataFrame, own: bool = False) -> DataFrame:
    """Rows of ``lower`` (doc_id, pre, path, ...) with the columns of each row of
    ``upper`` (_d, _a, _f, _path, ...) that stands for a node above, or the node itself
    with ``own``. Only prefixes as long as some path of ``upper`` are looked up."""
    levels = upper.agg(F.collect_set(F.size("_path"))).scalar()
    last = F.size("path") if own else F.size("path") - 1
    prefixes = F.transform(F.filter("_levels", lambda n: n <= last), lambda n: F.xxhash64(F.slice("path", 1, n)))
    low = lower.withColumn("_levels", levels).withColumn("_key", F.explode(prefixes)).drop("_levels")
    up = wide(upper.withColumn("_own", key("_path")).drop("_path"))
    inside = (F.col("pre") >= F.col("_a") if own else F.col("pre") > F.col("_a")) & (F.col("pre") <= F.col("_f"))
    return low.join(up, (F.col("doc_id") == F.col("_d")) & (F.col("_key") == F.col("_own")) & inside).drop("_key", "_own", "_d")
