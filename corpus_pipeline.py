"""A corpus pipeline of five stages over ``documents``.

Each stage gets what its predecessor kept, written as Parquet and read again. The
first four return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import decontam, packing, quality, secrets, similar
from sylva.llm.common import read, scratch, stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8
    or more) stays, that of the smallest id."""
    return similar.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontam.remove(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that are secrets are replaced in the texts; all documents stay."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: Fitted weights and tokenised pieces have no SQL form; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage stages for itself is deleted when its
    result is written; the last one's result is read from its own tables.

    Defined results: an empty table gives no rows; null texts are rejected by the first
    stage as blank ones are; repeated rows and equal ids are rows like others until the
    second keeps one of each group; ties there go to the smallest id and then the first
    row; very long texts are read whole by all stages; extra columns of ``documents``
    stay, whatever their names, up to the last stage."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, apply) in enumerate(STAGES[:-1]):
        with scratch(spark) as kept:
            docs = stage(apply(spark, docs, sf_dir), f"stage{k}")
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
