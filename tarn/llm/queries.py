"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import flac, langid, line_dedup, lm_score, mixing, quality, sentencepiece_codec, simhash, suffix_dedup, warc
from tarn.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.query(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.query(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.query(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(table(spark, sf_dir, "documents"), passages=True)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_source_mixing": op4_source_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash,
    "op7_flac": op7_flac,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_suffix_dedup": op10_suffix_dedup,
}
SQL: dict[str, str] = {
    "op2_quality_rules": quality.SQL,
    "op3_warc": warc.SQL,
    "op4_source_mixing": mixing.SQL,
    "op5_line_dedup": line_dedup.SQL,
}
