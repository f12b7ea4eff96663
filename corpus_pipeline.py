"""The training-data pipeline: each stage takes what the one before kept, as Parquet.

Quality rules drop what they reject; of near copies one document stays; documents that hold a benchmark passage go;
secrets are replaced in the texts; mixing draws each source to its target. All stages but the last return the columns of documents; the
last adds size, source_size, target, copies and taken, for the documents that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colwright.llm import contamination, mixing, quality, secrets, simhash
from colwright.llm.text import free_name
from colwright.sources.shared import kept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the cascade, unchanged.

    Null and empty texts have too few words and go. Copies are judged each by itself; an empty table gives an empty one. Columns
    beyond those of documents come along, whatever their names.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, unchanged: a row of the smallest doc_id, nulls last.

    Texts without words (null, empty) have one fingerprint, so one of them stays; of rows that share that doc_id, too.
    An empty table gives an empty one. Other columns come along.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, unchanged.

    Null and empty texts hold none and stay, as do all documents if the benchmark is empty. Copies go or stay together. Other columns,
    `hits` among them, come along.
    """
    return contamination.remove_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with placeholders for secrets; n_chars follows the text where one was replaced.

    No row goes. Null texts stay null, with their n_chars. An empty table gives an empty one. Other columns come along, whatever
    their names.
    """
    hidden = {c: free_name(docs, f"__{c}") for c in docs.columns if c.lower() in ("spans", "base_spans")}
    clean = secrets.redact(secrets.scan(docs.withColumnsRenamed(hidden)))
    length = F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies (1 or 2) and taken, which replace columns of these names.

    A null source is one of its own. Texts without words have the copies that are certain. Which of several rows alike in all
    columns is taken is open. An empty table gives an empty one.
    """
    return mixing.mix(docs, mixing.text_words(F.col("text"))).filter("copies > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]

# Fingerprints, edit distances and chance draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
