"""The registered query of each training-data operator, with its SQL where SQL can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, mixing, near_dedup, pii, quality, token_counts, token_output, warc
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as the reader finds it in the archives."""
    scratch = Scratch(spark, "op1")
    files = warc.write_archives(_table(spark, sf_dir, "pages"), scratch)
    return warc.read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mix = mixing.mix(_table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, verbatim or with other slot values."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), any_case=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"), token_output.vocabulary_path("byte_bpe_50k.tiktoken"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines that stand in several sources."""
    docs = _table(spark, sf_dir, "documents").withColumn("site", F.col("source"))
    lines = line_dedup.boilerplate(docs, Scratch(spark, "op6"))
    left = line_dedup.remove_boilerplate(docs, lines)
    return left.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the ORC files."""
    return token_output.encoded(_table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completions of every pair of conversations."""
    return chat.preference_pairs(_table(spark, sf_dir, "conversations"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_output": op7_token_output,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_pii": op9_pii,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

_WARC_ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= {warc.MIN_REVISIT_BYTES} GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= {warc.MIN_REVISIT_BYTES}
"""

ORACLES: dict[str, str] = {
    "op1_warc": _WARC_ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
}
