"""A corpus pipeline: language, near duplicates, benchmark passages, mixture, shards.

Each stage takes (session, documents, folder of the tables) and returns documents with the same columns;
the last adds the shard. Between stages the rows are written as Parquet and read again, so a lost executor
repeats a part of one stage. Rows with nulls, empty texts or equal ids are handled as the operators say:
texts without a letter go in the first stage, rows without a doc_id stay in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm.decontamination import clean_documents
from flowtide.llm.kd_sharding import prepare, shard
from flowtide.llm.language_kernel import in_known_language
from flowtide.llm.minhash import deduplicated
from flowtide.llm.temperature_mixing import mixed_documents
from flowtide.session import materialize, table

#: Documents need this score in their language; sources are repeated up to this often; shards.
LEAST_SCORE, MAX_REPEATS, SHARDS = 0.3, 1.5, 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; without one, null and empty texts among them, they go."""
    return in_known_language(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: word 5-grams, a similarity of 0.8 or more."""
    return deduplicated(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest source once, smaller ones up to ``MAX_REPEATS`` times: rows are repeated, none is left out."""
    return mixed_documents(docs, max_repeats=MAX_REPEATS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard``, 0 to 7, of near equal bytes."""
    placed = shard(prepare(docs), SHARDS)
    return placed.select(F.col("row.*"), "shard")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Language identification has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
