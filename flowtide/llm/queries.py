"""Named queries of the corpus operators, each over its whole table, and their checking SQL."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from flowtide.llm import conversation_trie, decontamination, license_diagonals, license_sql, periodic_runs, secret_ownership
from flowtide.llm.html_consensus import extracted_pages
from flowtide.llm.kd_sharding import shard_documents
from flowtide.llm.language_kernel import languages
from flowtide.llm.minhash import near_duplicates
from flowtide.llm.quality_rules import quality_report
from flowtide.llm.temperature_mixing import mixture
from flowtide.llm.token_histogram import token_lengths
from flowtide.llm.toxicity import toxicity
from flowtide.plans.registry import QueryFn
from flowtide.session import table

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_html_consensus")
def op1_html_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return extracted_pages(table(spark, folder, "pages"))


@query("op2_secret_ownership", secret_ownership.SQL)
def op2_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_ownership.secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[secret_ownership.kinds_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_ownership.listed(F.col("base")), 256).alias("base_sha256"),
        secret_ownership.listed(F.col("spans")).alias("spans"), "n_live", "n_copied",
    )


@query("op3_temperature_mixing")
def op3_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), max_repeats=2.0)


@query("op4_decontamination", decontamination.SQL)
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op5_language_kernel")
def op5_language_kernel(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"))


@query("op6_license_diagonals", license_sql.SQL)
def op6_license_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    return license_diagonals.licenses(table(spark, folder, "documents"))


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_report(table(spark, folder, "documents"))


@query("op8_minhash_dedup")
def op8_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op9_token_histogram")
def op9_token_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return token_lengths(table(spark, folder, "documents"))


@query("op10_kd_sharding")
def op10_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"), 8)


def stuttered(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For a tenth of the documents the words from one place on repeat a few of them."""
    h = 0 if doc_id is None else crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    start = g % len(words)
    period = 1 + (len(words) - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(len(words) - start)]


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, folder, "documents"), stuttered)
    runs, best = F.col("runs"), F.col("longest")
    return found.withColumn("longest", periodic_runs.longest(runs)).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(runs), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_toxicity_gru")
def op12_toxicity_gru(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_conversation_trie", conversation_trie.SQL)
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, folder, "conversations"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
