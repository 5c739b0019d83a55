"""The feature-engineering step: ten trailing features and three categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.flow import port_category, protocol_category
from flowtide.operators.rolling import destination_features, rolling_by, source_features

CONSUMED = ["ts", "src_port", "dst_port", "protocol"]


def add_rolling_features(df: DataFrame, window: str | int = "1s", window_name: str = "1s", ts: str = "ts") -> DataFrame:
    """All ten trailing features: one timeline per source, one per destination."""
    plan = {"src_ip": source_features(window_name), "dst_ip": destination_features(window_name)}
    return rolling_by(df, plan, window, ts)


def add_categories(df: DataFrame, on_unknown: str = "error") -> DataFrame:
    return df.withColumns(
        {
            "DstPortCategory": port_category(F.col("dst_port")),
            "SrcPortCategory": port_category(F.col("src_port")),
            "ProtocolCategory": protocol_category(F.col("protocol"), on_unknown),
        }
    )


def engineer_features(
    df: DataFrame, window: str | int = "1s", window_name: str = "1s", on_unknown: str = "error", ts: str = "ts"
) -> DataFrame:
    """Trailing features and categories, without the columns they were made from."""
    featured = add_categories(add_rolling_features(df, window, window_name, ts), on_unknown)
    return featured.drop(*[c for c in [*CONSUMED, ts] if c in featured.columns])
