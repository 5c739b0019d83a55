"""The report as tables: sample rows, previews, product lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.flow import two_decimals
from flowtide.functions.text import fallback_topic, strip_code_fence, traffic_badge
from flowtide.operators.matching import first_per_query
from flowtide.schemas import PRODUCT_LIST_SCHEMA

# Products recommended when no search result is at hand
# (topic, name, type, description, url, relevance).
FALLBACK_PRODUCTS = [
    (
        "flood", "Cloudflare DDoS Protection", "DDoS Protection",
        "Cloud-based DDoS protection service that mitigates large-scale distributed denial-of-service attacks at the network edge.",
        "https://www.cloudflare.com/ddos/", 9.2,
    ),
    (
        "flood", "AWS Shield Advanced", "DDoS Protection",
        "Managed DDoS protection service that safeguards applications running on AWS against larger and more sophisticated attacks.",
        "https://aws.amazon.com/shield/", 8.8,
    ),
    (
        "password", "Fail2ban", "Intrusion Prevention",
        "Log-parsing application that protects Linux and Unix servers from brute-force attacks by monitoring log files and blocking suspicious IP addresses.",
        "https://github.com/fail2ban/fail2ban", 8.5,
    ),
    (
        "password", "CrowdStrike Falcon", "Endpoint Protection",
        "Cloud-native endpoint protection platform with advanced threat detection and response capabilities including brute force attack prevention.",
        "https://www.crowdstrike.com/en-us/platform/", 9.0,
    ),
    (
        "general", "Palo Alto Networks Next-Generation Firewall", "Network Security",
        "Enterprise-grade firewall with advanced threat prevention, intrusion detection, and application-level security features.",
        "https://www.paloaltonetworks.com/", 9.3,
    ),
    (
        "general", "Snort IDS/IPS", "Intrusion Detection/Prevention",
        "Open source network intrusion detection and prevention system capable of performing real-time traffic analysis and packet logging.",
        "https://www.snort.org/", 8.7,
    ),
    (
        "general", "Splunk Enterprise Security", "SIEM",
        "Security information and event management platform that provides real-time monitoring, advanced analytics, and incident response capabilities.",
        "https://www.splunk.com/en_us/products/enterprise-security.html", 8.9,
    ),
]
PREVIEW = 3


def fallback_products(df: DataFrame, product_query: str) -> DataFrame:
    """Every row with the products of its query's topic (two or three rows each)."""
    catalogue = df.sparkSession.createDataFrame(
        FALLBACK_PRODUCTS, "topic string, name string, type string, description string, url string, relevance_score double"
    )
    return df.withColumn("topic", fallback_topic(F.col(product_query))).join(catalogue, "topic")


def json_products(df: DataFrame, answer: str, keep: Sequence[str]) -> DataFrame:
    """Products of fenced JSON answers, one per row; an unreadable answer yields none."""
    parsed = F.from_json(strip_code_fence(F.col(answer)), PRODUCT_LIST_SCHEMA)
    return df.select(*keep, F.inline_outer(parsed)).where(F.col("name").isNotNull())


def preview(df: DataFrame, group: str, value: str, order: Sequence[Column], n: int = PREVIEW) -> DataFrame:
    """The first ``n`` values of each group as text, and how many more there are."""
    shown = (
        first_per_query(df, group, order, n)
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v")))).alias("__v"))
        .select(group, F.array_join(F.transform("__v", lambda x: x["v"]), ", ").alias("shown"))
    )
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.join(shown, group).select(group, "shown", F.greatest(F.col("__n") - n, F.lit(0)).cast("long").alias("more"))


def report_rows(df: DataFrame, row_id: str, traffic_type: Column, prediction: Column) -> DataFrame:
    """Displayed fields of every sample."""
    return df.select(
        F.col(row_id).cast("long").alias("sample_id"),
        F.col("dst_ip").alias("dest_ip"),
        F.col("protocol").cast("int").alias("protocol"),
        two_decimals(F.col("flow_bytes_s")).alias("flow_bytes_s"),
        F.col("src_ip").alias("source_ip"),
        F.col("dst_port").cast("int").alias("dest_port"),
        two_decimals(F.col("flow_duration")).alias("flow_duration"),
        two_decimals(F.col("flow_packets_s")).alias("flow_packets_s"),
        F.col("src_port").cast("int").alias("source_port"),
        F.concat(F.lit("sample_"), F.col(row_id).cast("string"), F.lit(".html")).alias("detail_url"),
        traffic_type.alias("traffic_type"),
        traffic_badge(prediction).alias("badge"),
    )


REPORT_SCHEMA = (
    "sample_id long, dest_ip string, protocol int, flow_bytes_s string, source_ip string, dest_port int, "
    "flow_duration string, flow_packets_s string, source_port int, detail_url string, traffic_type string, badge string"
)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("badge").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(path)
