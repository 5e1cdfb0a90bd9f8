"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, fingerprint, html_extract, language_id, license_scan, merkle, near_dedup, packing, quality_rules, secret_scan, url_filter
from .common import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs))
    return judged.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "phrase_rate")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.transform("licences", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["n_lines"].cast("string"), x["family"], F.when(x["confirmed"], "confirmed").otherwise("unconfirmed")))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"), F.array_join(listed, ",").alias("findings"),
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extract, op2_url_filter, op3_language_id, op4_secret_scan, op5_order_minhash, op6_bpe, op7_license_scan, op8_near_dedup, op9_packing, op10_quality_rules, op11_alignment, op12_merkle, op13_decontaminate)
}
ORACLE_SQL = {
    "op10_quality_rules": quality_rules.SQL.format(docs="documents"),
    "op12_merkle": merkle.sql("documents"),
    "op13_decontaminate": decontaminate.SQL.format(docs="documents", items="benchmark"),
}
