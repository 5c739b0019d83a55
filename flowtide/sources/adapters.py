"""Views of the given tables in the shapes the operators work on.

Each view is a row-local projection (or a projection over another view), so Catalyst
prunes and pushes through it down to the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.session import table

# Destination ports dealt to the flows view, in order of props' number mod 12.
VIEW_PORTS = [80, 8080, 443, 22, 53, 25, 587, 21, 3306, 1000, 50000, 30000]


def _text(column) -> Column:
    return F.col(column).cast("string") if isinstance(column, str) else column.cast("string")


def flows(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    number = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    port = F.element_at(F.array(*[F.lit(p) for p in VIEW_PORTS]), number % len(VIEW_PORTS) + 1)
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("flow_id"),
        "ts",
        F.concat(
            F.lit("10.0."), _text(F.floor(F.col("user_id") / 250).cast("int")),
            F.lit("."), _text(F.col("user_id") % 250 + 1),
        ).alias("src_ip"),
        F.concat(F.lit("10.1.0."), _text(number % 20 + 1)).alias("dst_ip"),
        (F.lit(1024) + F.col("event_id") % 64000).cast("int").alias("src_port"),
        port.cast("int").alias("dst_port"),
        F.when(kind == "signup", 0).when(kind == "error", 17).otherwise(6).alias("protocol"),
        (F.col("value") * 1000).alias("flow_duration"),
        (F.col("value") * 100).alias("flow_bytes_s"),
        F.col("value").alias("flow_packets_s"),
        F.when(kind == "view", "Benign")
        .when(kind == "error", "DNS Flood")
        .when(kind == "signup", "ICMP Flood")
        .when(kind == "purchase", "Dictionary Attack")
        .otherwise("Port Scan")
        .alias("label"),
    )


def votes(spark: SparkSession, folder: str) -> DataFrame:
    label, row = F.col("label"), F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        row.alias("row_id"),
        (label % 4).alias("truth"),
        (label % 4).alias("rfc"),
        ((label + row % 2) % 4).cast("int").alias("xgb"),
        ((label + row % 3) % 4).cast("int").alias("mlp"),
        ((label + row % 5) % 4).cast("int").alias("knn"),
    )


def vote_classes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select((F.col("label") % 4).alias("class_id")).distinct()


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """One score per row and class; the class list is a property of the view (mod 4)."""
    present = F.array(*[F.lit(c) for c in range(4)])
    return votes(spark, folder).select(
        "row_id", "truth", F.explode(present).alias("class_id")
    ).withColumn(
        "score", ((F.col("row_id") * 37 + F.col("class_id") * 11) % 101).cast("double") / 101
    )


def hosts(spark: SparkSession, folder: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, folder, "supplier").select(
        key.alias("host_id"),
        F.concat(F.lit("10.0."), _text(nation), F.lit("."), _text(key % 250 + 1)).alias("ipv4"),
        (nation + 1).alias("dpid"),
        (key % 4 + 1).cast("int").alias("port_no"),
        (F.col("s_acctbal") < 0).alias("is_blocked"),
    )


def switches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        (F.col("n_nationkey") + 1).alias("dpid"), F.col("n_name").alias("switch_name")
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    tail = F.when(F.col("p_size") % 3 == 0, " for enterprise networks").otherwise(" appliance")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("type"),
        F.concat("p_name", tail).alias("description"),
    )


def flow_stats(spark: SparkSession, folder: str) -> DataFrame:
    fid = F.col("flow_id")
    match = (
        F.when(
            fid % 2 == 0,
            F.concat(
                F.lit('"ipv4_src":"'), "src_ip", F.lit('","ipv4_dst":"'), "dst_ip",
                F.lit('","ip_proto":"'), _text("protocol"), F.lit('","tcp_dst":"'), _text("dst_port"), F.lit('"'),
            ),
        )
        .when(fid % 7 == 0, F.lit('"in_port":"1"'))
        .otherwise(
            F.concat(F.lit('"nw_src":"'), "src_ip", F.lit('","nw_dst":"'), "dst_ip", F.lit('","nw_proto":"1"'))
        )
    )
    return flows(spark, folder).select(
        "flow_id",
        F.concat(
            F.lit('{"match":{'), match,
            F.lit('},"duration_sec":'), _text(fid % 5),
            F.lit(',"duration_nsec":'), _text(fid % 3 * 500000000),
            F.lit(',"packet_count":'), _text(fid % 997),
            F.lit(',"byte_count":'), _text(fid * 13), F.lit("}"),
        ).alias("raw_json"),
    )


def cve_feed(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    metric = F.when(doc % 3 == 0, "cvssMetricV31").when(doc % 3 == 1, "cvssMetricV30").otherwise("cvssMetricV2")
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(
            F.lit('{"cve":{"id":"'), F.when(doc % 9 == 0, "BAD-").otherwise("CVE-2024-"),
            F.lpad(_text(doc), 6, "0"), F.lit('","descriptions":[{"lang":"'), "lang",
            F.lit('","value":"n'), _text("n_chars"), F.lit('"}],"metrics":{"'), metric,
            F.lit('":[{"cvssData":{"baseScore":'), _text(F.col("n_chars") % 10), F.lit("}}]}}}"),
        ).alias("raw_json"),
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    fid = F.col("flow_id")
    body = (
        F.when(
            fid % 3 == 0,
            F.concat(
                F.lit(
                    ". curl -X POST http://ctl/stats/flowentry/add -d "
                    "'{\"dpid\": 1, \"priority\": 100, \"match\": {\"ipv4_src\": \""
                ),
                "src_ip",
                F.lit("\", \"eth_type\": 2048}, \"actions\": []}'"),
            ),
        )
        .when(
            fid % 3 == 1,
            F.lit(
                ". curl -X POST http://ctl/stats/flowentry/add -d "
                "'{\"dpid\": 1, \"match\": {\"tcp_dst\": 22}, \"actions\": [\"OUTPUT\"]}'"
            ),
        )
        .otherwise(F.lit(". no command"))
    )
    return (
        flows(spark, folder)
        .where(F.col("label") != "Benign")
        .select(
            fid.alias("response_id"),
            F.concat(F.lit("Assessment for Src IP: "), "src_ip", body).alias("output"),
        )
    )


def search_blocks(spark: SparkSession, folder: str) -> DataFrame:
    page = F.col("page_id")
    return table(spark, folder, "pages").select(
        page.alias("block_id"),
        F.concat(
            F.lit("Title: Vendor "), _text(page % 40), F.lit("\nURL: "), "url",
            F.lit("\nDescription: d"), _text(page), F.lit("\n"),
        ).alias("block"),
    )


def packets(spark: SparkSession, folder: str) -> DataFrame:
    fid = F.col("flow_id")
    return flows(spark, folder).select(
        fid.alias("packet_id"),
        "ts",
        (fid % 3 + 1).cast("int").alias("dpid"),
        F.col("src_ip").alias("src"),
        F.replace("dst_ip", F.lit("10.1."), F.lit("10.0.")).alias("dst"),
        (fid % 4 + 1).cast("int").alias("in_port"),
    )
