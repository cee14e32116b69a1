"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown, chat, decontam, html_crf, packing, pii, quality, sharding, simhash, warc
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op2_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.digest(html_crf.extract(table(spark, sf_dir, "pages")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(*quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve(warc.captures(table(spark, sf_dir, "pages"))))


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.formatted(chat.with_probe(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_html_crf, op3_quality, op4_sharding, op5_warc_revisits, op6_brown, op7_packing, op8_simhash, op9_decontamination, op10_chat_format,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_warc_revisits": warc.ORACLE,
    "op9_decontamination": decontam.ORACLE,
    "op10_chat_format": chat.ORACLE,
}
