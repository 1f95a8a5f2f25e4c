"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, embeddings, langid, lines, pieces, pii, quality, secretscan
from tidemark.llm._shared import table
from tidemark.llm.simhash import near_duplicates


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and one more, -7, whose texts look like the template."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    return chat.read_back(chat.format_windows(turns.union(hard)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, n_pieces, lossless, ids` of every document."""
    found = pieces.encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "lossless", "ids")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, n_lines, n_gone, text`: the lines a document had and lost, and what is left of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    return lines.dedup_lines(docs).select("doc_id", "n_lines", F.col("__tm_gone").alias("n_gone"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op6_embeddings": op6_embeddings,
    "op5_secrets": op5_secrets,
    "op7_pii": op7_pii,
    "op8_pieces": op8_pieces,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op9_decontamination": decontam.SQL,
}
