"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
Null, empty and letterless texts are rejected by the first stage; repeated rows pass as often
as they come until near duplicates go; an empty table stays empty; further columns, of any
name, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, near_dedup, packing, quality_rules, secret_scan
from tidemark.llm.common import materialise, release, set_aside, table

#: Texts of this many characters and more, of which the best language needs this many phrases a letter, are of no learned language.
ALIEN_CHARS, ALIEN_RATE = 40, 0.6


def _named(rows: DataFrame, names: dict[str, str], own: dict[str, Column] | None = None) -> DataFrame:
    """The columns that set_aside renamed, by their own names; those of `own` made anew."""
    return rows.select(*[(own or {}).get(c, F.col(now)).alias(c) for c, now in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null, empty or letterless texts, and those that no learned language explains."""
    rows, names = set_aside(docs, "doc_id", "text", "lang")
    judged = language_id.identify(rows, language_id.learn(rows))
    alien = (F.length("text") >= ALIEN_CHARS) & (F.col("phrase_rate") >= ALIEN_RATE)
    return _named(judged.where((F.col("lang_pred") != "und") & ~alien), names)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules, or a soft rule that binds on their source."""
    rows, names = set_aside(docs, "text", "source")
    return _named(quality_rules.quality_rules(rows, keep_text=True).where("kept"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return near_dedup.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind; n_chars, if there is one, follows the text. Keeps every document."""
    rows, names = set_aside(docs, "text")
    own = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return _named(secret_scan.scan_documents(rows, replace=True), names, own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document that is left into sequences; one row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]
#: Suffix automata, BagMinHash and packing aren't expressible in SQL: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        release(before)
    return docs
