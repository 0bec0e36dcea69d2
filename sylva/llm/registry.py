"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dac, decontam, gif, licenses, packing, quality, secrets, sharding, simhash, toxicity
from .common import read


def op1_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


def op5_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op6_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op9_token_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_documents(dac.write_tokens(read(spark, sf_dir, "documents")))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.media_columns(gif.store(read(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_bayes": op1_quality_bayes,
        "op2_hilbert_shards": op2_hilbert_shards,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_simhash_pigeonring": op4_simhash_pigeonring,
        "op5_toxicity_ordinal": op5_toxicity_ordinal,
        "op6_wu_manber": op6_wu_manber,
        "op7_license_sentences": op7_license_sentences,
        "op8_secret_battery": op8_secret_battery,
        "op9_token_dac": op9_token_dac,
        "op10_gif_media": op10_gif_media,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_wu_manber": decontam.ORACLE, "op7_license_sentences": licenses.ORACLE}
