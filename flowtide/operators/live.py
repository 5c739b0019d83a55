"""From flow-statistics polls to feature rows, and rule storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.flow import flow_endpoints, flow_rates, match_fields
from flowtide.operators.rules import rule_key
from flowtide.sources import keyed
from flowtide.sources.files import explode_polls

# Label of rows that have none yet.
PLACEHOLDER_LABEL = "Unknown"
RULE_COLUMNS = ["command_type", "description", "rule_json", "priority", "dpid", "src_ip"]


def ipv4_only(entries: DataFrame) -> DataFrame:
    """Entries whose match names an IPv4 source under either protocol version."""
    match = F.col("entry.match")
    return entries.where(F.map_contains_key(match, "ipv4_src") | F.map_contains_key(match, "nw_src"))


def normalise_entries(entries: DataFrame, keep: list[str]) -> DataFrame:
    """Addresses, ports, protocol, duration and rates of each entry."""
    counters = ["duration_sec", "duration_nsec", "byte_count", "packet_count"]
    fields = match_fields(F.col("entry.match"))
    read = entries.select(*keep, *[c.alias(n) for n, c in fields.items()], *[F.col(f"entry.{c}") for c in counters])
    endpoints = flow_endpoints(*[F.col(n) for n in fields])
    rates = flow_rates(*[F.col(c) for c in counters])
    return read.select(*keep, *[c.alias(n) for n, c in {**endpoints, **rates}.items()])


def live_flows(polls: DataFrame, column: str = "raw_json", keep: tuple[str, ...] = (), now: Column | None = None) -> DataFrame:
    """Feature rows of all IPv4 entries in the polls, stamped with the time of reading."""
    entries = ipv4_only(explode_polls(polls, column, keep))
    rows = normalise_entries(entries, [*keep, "dpid"])
    return rows.withColumns(
        {"ts": now if now is not None else F.current_timestamp(), "label": F.lit(PLACEHOLDER_LABEL)}
    )


def append_rules(rules: DataFrame, path: str) -> None:
    """Store rules once: a rule already in the table, or twice in the batch, is not added."""
    keyed_rules = rules.select(*RULE_COLUMNS).withColumn("rule_key", rule_key("command_type", "priority", "rule_json"))
    # read several times: the rules are made once, and the state of a stream is opened and changed once
    once = keyed_rules.dropDuplicates(["rule_key"]).persist()
    try:
        keyed.append_keyed(keyed.unstored(once, path, "rule_key"), path, "rule_key")
    finally:
        once.unpersist()


def reset_rules(spark: SparkSession, path: str, schema) -> None:
    """Start the rule table afresh, empty."""
    keyed.create_keyed(spark, path, schema)
