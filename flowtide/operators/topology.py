"""Network graph tables: hosts, switches, links, forwarding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.timing import event_micros
from flowtide.operators.rules import host_name
from flowtide.operators.segments import ROWS_PER_CUT, even_cuts, last_known, numbered

# The switch-local port, default hosts, reply for an unknown destination.
LOCAL_PORT = 4294967294
DEFAULT_HOSTS = [(1, 1, "10.0.0.1"), (2, 1, "10.0.0.2"), (3, 1, "10.0.0.3")]
FLOOD = "FLOOD"
LLDP_TYPE = 35020


def _text(column: Column) -> Column:
    return column.cast("string")


def _flat(ip: Column) -> Column:
    return F.replace(ip, F.lit("."), F.lit("_"))


def infer_host_ip(dpid: Column, port: Column) -> Column:
    """Address expected behind a switch port."""
    return F.when(
        (port == 1) & dpid.isin(1, 2, 3), F.concat(F.lit("10.0.0."), _text(dpid))
    ).otherwise(F.concat(F.lit("10.0."), _text(dpid), F.lit("."), _text(port)))


def host_ports(ports: DataFrame, switches: DataFrame) -> DataFrame:
    """Hosts inferred from ports of known switches; the default hosts only if there are none."""
    p = F.col("port_no")
    facing = F.contains(F.coalesce("port_name", F.lit("")), F.lit("eth1")) | (p == 1)
    known = switches.select("dpid").distinct()
    discovered = (
        ports.where((p != 0) & (p != LOCAL_PORT) & facing)
        .join(known, "dpid", "left_semi")
        .select("dpid", "port_no", "port_name", infer_host_ip(F.col("dpid"), p).alias("ipv4"))
    )
    defaults = (
        ports.sparkSession.createDataFrame(DEFAULT_HOSTS, "dpid long, port_no long, ipv4 string")
        .join(known, "dpid", "left_semi")
        .select("dpid", "port_no", F.lit(None).cast("string").alias("port_name"), "ipv4")
        .where(~discovered.select("dpid").exists())
    )
    # hosts are numbered over all switches
    hosts = discovered.unionByName(defaults)
    counted = numbered(hosts, "dpid", [F.col("dpid"), F.col("port_no"), F.col("port_name")], "port_no")
    return counted.select(
        "dpid", "port_no", "ipv4", F.concat(F.lit("00:00:00:00:00:0"), _text(F.col("n"))).alias("mac")
    )


def with_host_names(df: DataFrame, names: DataFrame, ip: str, out: str = "host_name") -> DataFrame:
    """Name from the table of known hosts, else from the address itself. The join is a plain
    equi-join: Spark broadcasts the names only while they are under its size limit."""
    known = names.select(F.col("ipv4").alias(ip), F.col("name").alias("__name"))
    return df.join(known, ip, "left").withColumn(out, F.coalesce("__name", host_name(F.col(ip)))).drop("__name")


def with_blocked_flag(hosts: DataFrame, blocked: DataFrame, ip: str = "ipv4") -> DataFrame:
    flagged = blocked.select(ip).distinct().withColumn("__blocked", F.lit(True))
    return hosts.join(flagged, ip, "left").withColumn("is_blocked", F.coalesce("__blocked", F.lit(False))).drop("__blocked")


def linear_links(switches: DataFrame) -> DataFrame:
    """A link from each switch to the next by id."""
    counted = numbered(switches.select("dpid").distinct(), "dpid", [F.col("dpid")])
    following = counted.select(F.col("dpid").alias("next_dpid"), (F.col("n") - 1).alias("n"))
    return counted.join(following, "n").select("dpid", "next_dpid")


def topology_nodes(switches: DataFrame, hosts: DataFrame) -> DataFrame:
    """Switch and host nodes; ``hosts`` has ipv4, dpid, port_no and is_blocked."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    switch_nodes = switches.select(
        F.concat(F.lit("switch_"), _text(F.col("dpid"))).alias("id"),
        F.lit("switch").alias("type"),
        F.concat(F.lit("Switch "), _text(F.col("dpid"))).alias("label"),
        F.lit("active").alias("status"),
        text.alias("ip_address"),
        F.col("dpid").cast("long").alias("dpid"),
    )
    host_nodes = hosts.select(
        F.concat(F.lit("host_"), _flat(F.col("ipv4"))).alias("id"),
        F.lit("host").alias("type"),
        F.concat(F.lit("Host "), F.col("ipv4")).alias("label"),
        F.when(F.col("is_blocked"), "blocked").otherwise("active").alias("status"),
        F.col("ipv4").alias("ip_address"),
        number.alias("dpid"),
    )
    return switch_nodes.unionByName(host_nodes)


def topology_links(switches: DataFrame, hosts: DataFrame) -> DataFrame:
    host_id = F.concat(F.lit("host_"), _flat(F.col("ipv4")))
    switch_id = F.concat(F.lit("switch_"), _text(F.col("dpid")))
    host_links = hosts.select(
        F.concat(F.lit("link_"), host_id, F.lit("_"), switch_id).alias("id"),
        host_id.alias("source"),
        switch_id.alias("target"),
        F.col("port_no").cast("long").alias("target_port"),
        F.lit("active").alias("status"),
    )
    following = F.concat(F.lit("switch_"), _text(F.col("next_dpid")))
    switch_links = linear_links(switches).select(
        F.concat(F.lit("link_"), switch_id, F.lit("_"), following).alias("id"),
        switch_id.alias("source"),
        following.alias("target"),
        F.lit(None).cast("long").alias("target_port"),
        F.lit("active").alias("status"),
    )
    return host_links.unionByName(switch_links)


def topology_stats(nodes: DataFrame, links: DataFrame, applied: DataFrame) -> DataFrame:
    """Numbers of nodes, links, blocked hosts and applied rules, one row."""
    counted = (
        nodes.select(F.lit("node").alias("part"), (F.col("status") == "blocked").alias("blocked"))
        .unionByName(links.select(F.lit("link").alias("part"), F.lit(False).alias("blocked")))
        .unionByName(applied.select(F.lit("rule").alias("part"), F.lit(False).alias("blocked")))
    )
    return counted.agg(
        F.count_if(F.col("part") == "node").alias("total_nodes"),
        F.count_if(F.col("part") == "link").alias("total_links"),
        F.count_if(F.col("blocked")).alias("blocked_hosts"),
        F.count_if(F.col("part") == "rule").alias("applied_commands"),
    )


def switch_flow_counts(switches: DataFrame, entries: DataFrame) -> DataFrame:
    """Flow entries per switch, zero included; the entries stay rows of their own table."""
    counts = entries.groupBy("dpid").agg(F.count(F.lit(1)).alias("flow_count"))
    return switches.join(counts, "dpid", "left").withColumn("flow_count", F.coalesce("flow_count", F.lit(0)).cast("long"))


def _forwarded(packets: DataFrame) -> DataFrame:
    """Link-discovery frames take no part in forwarding."""
    return packets.where(F.col("eth_type") != LLDP_TYPE) if "eth_type" in packets.columns else packets


def mac_table(packets: DataFrame) -> DataFrame:
    """Port on which each source was last seen, per switch."""
    packets = _forwarded(packets)
    seen = F.struct(event_micros(packets, "ts").alias("us"), F.col("packet_id"))
    return packets.groupBy("dpid", "src").agg(F.max_by("in_port", seen).alias("port"))


def asof_forwarding(packets: DataFrame, rows: int = ROWS_PER_CUT) -> DataFrame:
    """Output port of each packet: where its destination was last seen at or before it, on the
    same switch, counting the packet's own source first; FLOOD when never seen."""
    packets = _forwarded(packets)
    timed = packets.select("packet_id", "dpid", "src", "dst", "in_port", event_micros(packets, "ts").alias("us"))
    cut = even_cuts(timed, "us", "packet_id", rows)
    observed = F.struct(F.col("src").alias("addr"), F.lit(0).alias("kind"), F.col("in_port").alias("port"))
    asked = F.struct(F.col("dst").alias("addr"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("port"))
    both = cut.select("packet_id", "dpid", "us", "__cut", F.inline_outer(F.array(observed, asked)))
    answered = last_known(
        both,
        ["dpid", "addr"],
        F.col("__cut"),
        [F.col("us"), F.col("packet_id"), F.col("kind")],
        "port",
        "out_port",
    )
    return answered.where(F.col("kind") == 1).select(
        "packet_id", F.coalesce(_text(F.col("out_port")), F.lit(FLOOD)).alias("out_port")
    )
