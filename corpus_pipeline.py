"""From raw documents to token files: quality, near-duplicates, decontamination, mixing, output."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, mixing, near_dedup, quality, token_output
from seqloom.llm.scratch import Scratch, dropped
from seqloom.session import prepare

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality rules keep."""
    prepare(spark)
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that with the smallest doc_id; rows that repeat an id with other texts are compared each."""
    prepare(spark)
    return near_dedup.distinct_documents(docs, Scratch(spark, "dedup"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without benchmark items."""
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_case=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does."""
    prepare(spark)
    return mixing.mixed(docs, Scratch(spark, "mix"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold of each row."""
    prepare(spark)
    return token_output.encoded(docs, Scratch(spark, "tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The trees of the first stage and the tokenizer of the last are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written and read again for the next stage, and then its predecessor goes.

    Stages called one by one keep their scratch tables, which their lazy results need, until the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, before = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        with dropped():
            docs = out.save(stage(spark, docs, sf_dir), name)
        if before:
            out.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
