"""File sources and sinks: flow CSV, derived datasets, JSON documents, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.functions.timing import parse_timestamp
from flowtide.schemas import CVE_RECORD_SCHEMA, FLOW_COLUMNS, FLOW_POLL_SCHEMA, FLOW_SCHEMA, TOPOLOGY_SCHEMA
from flowtide.session import path_exists

_BAD_ROW = "_corrupt_record"


def scan_flow_csv(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """Flow records under the fixed schema. Rows that do not fit it are left out, always the same ones
    whatever columns are read later; with ``quarantine`` they are written there as they came."""
    schema = T.StructType([*FLOW_SCHEMA.fields, T.StructField(_BAD_ROW, T.StringType())])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", _BAD_ROW).schema(schema).csv(path)
    # always true, but it makes Spark parse every column, so a bad row is found whatever a query reads
    read = F.xxhash64(*[F.col(f"`{f.name}`") for f in FLOW_SCHEMA.fields]) >= F.lit(-(1 << 63))
    if quarantine:
        rows.where(F.col(_BAD_ROW).isNotNull() & read).select(_BAD_ROW).write.mode("overwrite").text(quarantine)
    return rows.where(F.col(_BAD_ROW).isNull() & read).drop(_BAD_ROW)


def normalise_flows(raw: DataFrame) -> DataFrame:
    """Raw columns under the engine's names, with the time parsed and integer ports."""
    named = raw.select(*[F.col(f"`{name}`").alias(FLOW_COLUMNS.get(name, name)) for name in raw.columns])
    return named.withColumns(
        {
            "ts": parse_timestamp(F.col("ts")),
            "src_port": F.col("src_port").cast("int"),
            "dst_port": F.col("dst_port").cast("int"),
        }
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_dataset(df: DataFrame, base: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{base}/{name}")


def load_dataset(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}")


def load_or_build(spark: SparkSession, base: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The saved dataset if there is one, else build, save and read it."""
    if not path_exists(spark, f"{base}/{name}/_SUCCESS"):
        save_dataset(build(), base, name)
    return load_dataset(spark, base, name)


def scan_polls(spark: SparkSession, path: str) -> DataFrame:
    """Flow-statistics polls, one JSON document per line, as text for ``explode_polls``."""
    return spark.read.text(path).withColumnRenamed("value", "raw_json")


def explode_polls(polls: DataFrame, column: str = "raw_json", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (switch, flow entry); a document that does not parse yields none."""
    parsed = polls.select(*keep, F.from_json(F.col(column), FLOW_POLL_SCHEMA).alias("poll"))
    # The outer forms keep Spark from testing the size of the parsed document in a filter of its
    # own, which would parse every document again.
    by_switch = parsed.select(*keep, F.explode_outer("poll").alias("dpid", "entries"))
    entries = by_switch.select(*keep, F.col("dpid").cast("long").alias("dpid"), F.explode_outer("entries").alias("entry"))
    return entries.where(F.col("entry").isNotNull())


def bad_polls(polls: DataFrame, column: str = "raw_json") -> DataFrame:
    """Documents that do not parse, for the quarantine table."""
    return polls.where(F.from_json(F.col(column), FLOW_POLL_SCHEMA).isNull())


def parse_cve_feed(feed: DataFrame, column: str = "raw_json") -> DataFrame:
    return feed.withColumn("record", F.from_json(F.col(column), CVE_RECORD_SCHEMA))


def parse_topologies(documents: DataFrame, column: str = "raw_json", keep: tuple[str, ...] = ()) -> DataFrame:
    return documents.select(*keep, F.from_json(F.col(column), TOPOLOGY_SCHEMA).alias("topology"))


def scan_topology(spark: SparkSession, path: str) -> DataFrame:
    """A topology document spread over several lines."""
    return spark.read.schema(TOPOLOGY_SCHEMA).option("multiLine", True).json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
