"""Documents from files, and files from documents."""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva import ship

_BOMS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]


def decode(data: bytes | None, fixed: str | None = None) -> str | None:
    """The text of an entity: by ``fixed`` encoding, byte order mark, or declaration;
    else UTF-8. Null if it can't be decoded."""
    if data is None:
        return None
    name = fixed
    if name is None:
        for mark, encoding in _BOMS:
            if data.startswith(mark):
                data, name = data[len(mark) :], encoding
                break
    if name is None and data[:4] in (b"\0<\0?", b"<\0?\0"):
        name = "utf-16-be" if data[:1] == b"\0" else "utf-16-le"
    if name is None:
        m = re.match(rb"""<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z][\w.\-]*)["']""", data)
        name = m[1].decode() if m else "utf-8"
    try:
        return data.decode(name)
    except (LookupError, UnicodeDecodeError):
        return None


@F.arrow_udf(T.StringType())
def decode_column(contents: pa.Array) -> pa.Array:
    return pa.array([decode(x) for x in contents.to_pylist()], pa.string())


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, system_id, xml) of every file under a path; the id is a hash of the
    file's name, so that it doesn't depend on what else is there."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("system_id"), decode_column("content").alias("xml"))


def read_rows(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Rows of large documents, split at a tag by Spark's own reader."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """(doc_id, xml) as text, one document a line with its line ends as references."""
    line = F.replace(F.replace("xml", F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;"))
    docs.select(line.alias("value")).write.text(path)
