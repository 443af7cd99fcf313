"""A corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, secret redaction, packing.

Every stage works on all that its predecessor kept, and is written as Parquet and read again before the next. The stages decide about rows, not ids: null ids, and ids that
repeat with other texts, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import decontam, dedup, language, packing, secrets
from alphaloom.llm.common import removed, table, written

#: Numbers of rows up to this count are broadcast (8 bytes each); more are shuffled.
BROADCAST_IDS = 1_000_000
#: Near duplicates: words of a shingle are five, and this is the similarity in per cent.
SIMILAR = 80


def _numbered(docs: DataFrame) -> DataFrame:
    """row (all of docs' columns, as one struct, so that no name can clash), number, written: the numbers are those of one reading."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return written(docs.select(whole.alias("row"), F.monotonically_increasing_id().alias("number")), "rows")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The columns of the numbered rows whose number is not among gone (number, each once)."""
    gone = written(gone.select("number"), "gone")
    near = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(near, "number", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in rows.schema["row"].dataType.names))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can't be told go: null and empty ones, those without a letter, and those on which the machines only guess (language.LEAST_SCORE). Where lang is
    null, it is the predicted one. If no language could be learned, every text with a letter stays as it is. Repeated rows stay or go alike; an empty table gives no rows;
    all columns stay, whatever their names."""
    return language.with_language(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: of the least id, an id before none, and of rows that share it one. Texts without words are in no component; of rows that repeat such
    a text and the id, one stays. An empty table gives no rows; all columns stay, whatever their names."""
    rows = _numbered(docs)
    found = dedup.near_duplicates(_texts(rows), SIMILAR).select(F.col("doc_id").alias("number"), "n_shingles", "component_id")
    text, doc_id = F.col("row.text"), F.col("row.doc_id")
    blank = F.when(~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.struct(F.lit(1).alias("x"), text.alias("text")))
    named = rows.select("number", doc_id.alias("id"), F.xxhash64(text).alias("hash"), blank.alias("blank")).join(found, "number")
    lone = F.col("n_shingles") == 0
    group = [F.when(~lone, F.col("component_id")).alias("component"), F.when(lone, F.struct("id", "blank")).alias("same")]
    named = written(named.select("number", F.struct(F.isnull("id").alias("none"), "id", "hash", "number").alias("rank"), *group), "near")
    stays = named.groupBy("component", "same").agg(F.min("rank").alias("least")).select("least.number")
    out = _without(rows, named.select("number").join(stays, "number", "left_anti"))
    removed(named)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; null and empty texts hold none. Repeated rows stay or go alike, rows of one id each by its own text; an empty table gives no rows,
    an empty benchmark takes none; all columns stay, whatever their names."""
    rows = _numbered(docs)
    found = decontam.contaminated(_texts(rows), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.select(F.col("doc_id").alias("number")).distinct())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are masked and n_chars follows. Null and empty texts stay as they are, as do repeated rows and all columns, whatever their names; an
    empty table gives no rows."""
    return secrets.redact(docs, secrets.train(secrets.labelled_samples(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, a null or empty text as its end alone, as pieces in sequences; see packing.pack(). Repeated rows and null ids are documents of their own."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", redact_secrets), ("best_fit_packing", pack)]

#: The stages' models and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            removed(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
