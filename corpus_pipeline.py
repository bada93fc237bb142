"""A training-data pipeline over ``documents``: each stage calls one operator of
``casegrid.llm``, is written as Parquet and read back as the next one's input.

Every stage but the last returns the columns of ``documents``; null texts, repeated
ids and empty tables follow the operators' own rules, and extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import table, written
from casegrid.llm.decontaminate import clean
from casegrid.llm.near_dup import near_duplicates
from casegrid.llm.packing import pack
from casegrid.llm.secrets import redacted
from casegrid.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the table's labels."""
    return toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id (nulls first);
    of different texts with that id one, of rows that repeat an id and a text, one."""
    kept = near_duplicates(docs).where("survivor").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.xxhash64("text") == F.col("k_hash"))
    return docs.join(kept, same, "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows the text."""
    text = docs.select("doc_id", redacted().alias("text"), "lang", "source")
    return text.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of every document that is left."""
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated),
          ("secrets", redact_secrets), ("packing", pack_batches)]

#: SQL cannot express the learned first stage; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table's documents; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
