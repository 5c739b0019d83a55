"""Fixed schemas of the tables that cross the engine's boundaries."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of a raw flow record.
FLOW_SCHEMA = T.StructType(
    [
        T.StructField("Src IP", T.StringType()),
        T.StructField("Src Port", T.DoubleType()),
        T.StructField("Dst IP", T.StringType()),
        T.StructField("Dst Port", T.DoubleType()),
        T.StructField("Protocol", T.IntegerType()),
        T.StructField("Timestamp", T.StringType()),
        T.StructField("Flow Duration", T.DoubleType()),
        T.StructField("Flow Bytes/s", T.DoubleType()),
        T.StructField("Flow Packets/s", T.DoubleType()),
        T.StructField("Label", T.StringType()),
    ]
)

# The engine's own names for the raw columns, in the same order.
FLOW_COLUMNS = {
    "Src IP": "src_ip",
    "Src Port": "src_port",
    "Dst IP": "dst_ip",
    "Dst Port": "dst_port",
    "Protocol": "protocol",
    "Timestamp": "ts",
    "Flow Duration": "flow_duration",
    "Flow Bytes/s": "flow_bytes_s",
    "Flow Packets/s": "flow_packets_s",
    "Label": "label",
}

FLOW_STAT_SCHEMA = T.StructType(
    [
        T.StructField("match", T.MapType(T.StringType(), T.StringType())),
        T.StructField("duration_sec", T.DoubleType()),
        T.StructField("duration_nsec", T.DoubleType()),
        T.StructField("packet_count", T.DoubleType()),
        T.StructField("byte_count", T.DoubleType()),
    ]
)

# One poll of the flow-statistics endpoint: switch id -> its flow entries.
FLOW_POLL_SCHEMA = T.MapType(T.StringType(), T.ArrayType(FLOW_STAT_SCHEMA))

_CVSS = T.ArrayType(
    T.StructType(
        [
            T.StructField(
                "cvssData",
                T.StructType(
                    [
                        T.StructField("baseScore", T.StringType()),
                        T.StructField("baseSeverity", T.StringType()),
                    ]
                ),
            )
        ]
    )
)

CVE_RECORD_SCHEMA = T.StructType(
    [
        T.StructField(
            "cve",
            T.StructType(
                [
                    T.StructField("id", T.StringType()),
                    T.StructField(
                        "descriptions",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("lang", T.StringType()),
                                    T.StructField("value", T.StringType()),
                                ]
                            )
                        ),
                    ),
                    T.StructField(
                        "metrics",
                        T.StructType(
                            [
                                T.StructField("cvssMetricV31", _CVSS),
                                T.StructField("cvssMetricV30", _CVSS),
                                T.StructField("cvssMetricV2", _CVSS),
                            ]
                        ),
                    ),
                ]
            ),
        )
    ]
)

NODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("dpid", T.LongType()),
        T.StructField("port_count", T.LongType()),
        T.StructField("flow_count", T.LongType()),
        T.StructField("blocking_commands", T.ArrayType(T.StringType())),
    ]
)

LINK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("source_port", T.LongType()),
        T.StructField("target_port", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("bandwidth", T.StringType()),
    ]
)

TOPOLOGY_SCHEMA = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(NODE_SCHEMA)),
        T.StructField("links", T.ArrayType(LINK_SCHEMA)),
    ]
)

PRODUCT_LIST_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("relevance_score", T.DoubleType()),
        ]
    )
)
