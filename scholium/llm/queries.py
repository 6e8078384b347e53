"""The registered queries of this subpackage: thin, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, htmltext, langid, licenses, linededup, media, merkle, periodic, quality, simhash, stages, toxicity, warc
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.query(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.query(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.query(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.query(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query(table(spark, sf_dir, "documents", *merkle.FIELDS))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_toxicity, op3_language_id, op4_simhash, op5_line_dedup, op6_warc, op7_bpe, op8_decontamination, op9_media_columns, op10_license_scan,
        op11_periodic_runs, op12_quality, op13_merkle_manifest,
    )
}
QUERIES["pipeline"] = stages.run
ORACLES = {"op5_line_dedup": linededup.ORACLE, "op6_warc": warc.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
if stages.ORACLE_SQL:
    ORACLES["pipeline"] = stages.ORACLE_SQL
