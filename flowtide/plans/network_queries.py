"""Named queries over flow statistics, rules, topology and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.operators import live, rules, sampling, topology
from flowtide.plans.registry import query
from flowtide.session import fresh_path
from flowtide.sources import adapters, files

# -- flow statistics ---------------------------------------------------------------------


def _polls(spark, folder):
    """One poll document per flow entry, keyed by switch id."""
    return adapters.flow_stats(spark, folder).select(
        "flow_id",
        F.concat(F.lit('{"'), (F.col("flow_id") % 3 + 1).cast("string"), F.lit('":['), "raw_json", F.lit("]}")).alias("raw_json"),
    )


@query(
    "flow_stats_explode",
    """SELECT flow_id, flow_id % 3 + 1 AS dpid, CAST(json_extract_string(raw_json, '$.packet_count') AS DOUBLE) AS packet_count,
         CAST(json_extract_string(raw_json, '$.byte_count') AS DOUBLE) AS byte_count,
         coalesce(json_extract_string(raw_json, '$.match.ipv4_src'), json_extract_string(raw_json, '$.match.nw_src')) AS src
       FROM flow_stats""",
    "flow_stats",
)
def flow_stats_explode(spark, folder):
    """Polls written as a landing file, scanned and exploded to one row per flow entry."""
    path = fresh_path(spark, "polls")
    _polls(spark, folder).select(F.concat_ws("\t", F.col("flow_id").cast("string"), "raw_json").alias("value")).write.text(path)
    landed = files.scan_polls(spark, path).select(
        F.split("raw_json", "\t", 2)[0].cast("long").alias("flow_id"), F.split("raw_json", "\t", 2)[1].alias("raw_json")
    )
    entries = files.explode_polls(landed, keep=("flow_id",))
    match = F.col("entry.match")
    return entries.select(
        "flow_id", "dpid", "entry.packet_count", "entry.byte_count", F.coalesce(match["ipv4_src"], match["nw_src"]).alias("src")
    )


@query(
    "ipv4_flows",
    """SELECT flow_id FROM flow_stats WHERE json_extract_string(raw_json, '$.match.ipv4_src') IS NOT NULL
       OR json_extract_string(raw_json, '$.match.nw_src') IS NOT NULL""",
    "flow_stats",
)
def ipv4_flows(spark, folder):
    return live.ipv4_only(files.explode_polls(_polls(spark, folder), keep=("flow_id",))).select("flow_id")


_ENTRY_SQL = """SELECT flow_id, json_extract_string(raw_json, '$.match.ipv4_src') AS s4, json_extract_string(raw_json, '$.match.nw_src') AS sn,
    json_extract_string(raw_json, '$.match.ipv4_dst') AS d4, json_extract_string(raw_json, '$.match.nw_dst') AS dn,
    CAST(coalesce(nullif(json_extract_string(raw_json, '$.match.ip_proto'), '0'), json_extract_string(raw_json, '$.match.nw_proto')) AS INT) AS proto,
    CAST(json_extract_string(raw_json, '$.match.tcp_dst') AS DOUBLE) AS port,
    CAST(json_extract_string(raw_json, '$.duration_sec') AS DOUBLE) + CAST(json_extract_string(raw_json, '$.duration_nsec') AS DOUBLE) / 1000000000 AS secs,
    CAST(json_extract_string(raw_json, '$.packet_count') AS DOUBLE) AS packets,
    CAST(json_extract_string(raw_json, '$.byte_count') AS DOUBLE) AS bytes FROM flow_stats"""


@query(
    "flow_normalize",
    f"""SELECT flow_id, coalesce(s4, sn, '0.0.0.0') AS src_ip, coalesce(d4, dn, '0.0.0.0') AS dst_ip, 0.0::DOUBLE AS src_port,
         CASE WHEN proto = 1 THEN 0.0 ELSE coalesce(port, 0.0) END AS dst_port, CASE WHEN proto = 1 THEN 0 ELSE coalesce(proto, -1) END AS protocol
       FROM ({_ENTRY_SQL})""",
    "flow_stats",
)
def flow_normalize(spark, folder):
    entries = files.explode_polls(_polls(spark, folder), keep=("flow_id",))
    return live.normalise_entries(entries, ["flow_id"]).select(
        "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", F.coalesce("protocol", F.lit(-1)).alias("protocol")
    )


@query(
    "flow_rates",
    f"""SELECT flow_id, round(secs * 1000000, 6) AS flow_duration, round(CASE WHEN secs > 0 THEN bytes / secs ELSE 0 END, 6) AS flow_bytes_s,
         round(CASE WHEN secs > 0 THEN packets / secs ELSE 0 END, 6) AS flow_packets_s FROM ({_ENTRY_SQL})""",
    "flow_stats",
)
def flow_rates(spark, folder):
    entries = files.explode_polls(_polls(spark, folder), keep=("flow_id",))
    out = live.normalise_entries(entries, ["flow_id"])
    return out.select("flow_id", *[F.round(c, 6).alias(c) for c in ("flow_duration", "flow_bytes_s", "flow_packets_s")])


@query(
    "ipv4_normalize",
    """SELECT flow_id, CASE flow_id % 4 WHEN 1 THEN '0.0.0.0' WHEN 3 THEN '0.0.0.0' ELSE src_ip END AS ip FROM flows""",
    "flows",
)
def ipv4_normalize(spark, folder):
    """Valid addresses pass; an octet above 255 and a missing address become the default."""
    from flowtide.functions.flow import ipv4_or_default

    case = F.col("flow_id") % 4
    ip = F.when(case == 1, F.concat(F.lit("300."), "src_ip")).when(case == 3, F.lit(None)).otherwise(F.col("src_ip"))
    return adapters.flows(spark, folder).select("flow_id", ipv4_or_default(ip).alias("ip"))


@query(
    "live_features",
    f"""SELECT flow_id, flow_id % 3 + 1 AS dpid, coalesce(s4, sn) AS src_ip, CASE WHEN proto = 1 THEN 0 ELSE coalesce(proto, -1) END AS protocol,
         CASE WHEN proto = 1 THEN 0.0 ELSE coalesce(port, 0.0) END AS dst_port,
         round(CASE WHEN secs > 0 THEN bytes / secs ELSE 0 END, 6) AS flow_bytes_s, 'Unknown' AS label
       FROM ({_ENTRY_SQL}) WHERE s4 IS NOT NULL OR sn IS NOT NULL""",
    "flow_stats",
)
def live_features(spark, folder):
    """Polls to feature rows: explode, keep IPv4 entries, normalise, stamp."""
    out = live.live_flows(_polls(spark, folder), keep=("flow_id",))
    return out.select(
        "flow_id", "dpid", "src_ip", F.coalesce("protocol", F.lit(-1)).alias("protocol"), "dst_port", F.round("flow_bytes_s", 6).alias("flow_bytes_s"), "label"
    )


@query(
    "top_flows",
    f"SELECT flow_id, packets AS packet_count FROM ({_ENTRY_SQL})",
    "flow_stats",
)
def top_flows(spark, folder):
    entries = files.explode_polls(_polls(spark, folder), keep=("flow_id",))
    count = F.coalesce("entry.packet_count", F.lit(0.0))
    return entries.select("flow_id", count.alias("packet_count")).orderBy(F.col("packet_count").desc(), "flow_id")


@query(
    "switch_flow_counts",
    """SELECT s.dpid, s.switch_name, CAST(count(f.flow_id) AS BIGINT) AS flow_count FROM switches s
       LEFT JOIN flow_stats f ON s.dpid = f.flow_id % 3 + 1 GROUP BY s.dpid, s.switch_name""",
    "switches flow_stats",
)
def switch_flow_counts(spark, folder):
    entries = files.explode_polls(_polls(spark, folder), keep=("flow_id",))
    return topology.switch_flow_counts(adapters.switches(spark, folder), entries)


# -- rules -------------------------------------------------------------------------------

_RULE_SQL = """SELECT flow_id,
    CASE WHEN k = 'icmp' THEN 'block_icmp' WHEN ported THEN concat('block_', k, '_port') ELSE 'block_host' END AS command_type,
    CASE WHEN k = 'icmp' THEN concat('Block ICMP (ping) from ', host, ' (', src_ip, ')')
      WHEN ported THEN concat('Block ', upper(k), ' traffic to port ', CAST(dst_port AS VARCHAR), ' from ', host, ' (', src_ip, ')')
      ELSE concat('Block all traffic from host ', host, ' (', src_ip, ')') END AS description,
    CASE WHEN k <> 'icmp' AND ported THEN 200 ELSE 100 END AS priority,
    CASE WHEN k = 'icmp' THEN concat('{"dpid": 2, "priority": 100, "match": {"eth_type": 2048, "ip_proto": 1, "ipv4_src": "', src_ip, '"}, "actions": []}')
      WHEN ported THEN concat('{"dpid": 2, "priority": 200, "match": {"eth_type": 2048, "ip_proto": ', CASE k WHEN 'udp' THEN '17' ELSE '6' END,
        ', "', k, '_dst": ', CAST(dst_port AS VARCHAR), ', "ipv4_src": "', src_ip, '"}, "actions": []}')
      ELSE concat('{"dpid": 2, "priority": 100, "match": {"ipv4_src": "', src_ip, '", "eth_type": 2048}, "actions": []}') END AS rule_json, label, src_ip
  FROM (SELECT *, CASE protocol WHEN 17 THEN 'udp' WHEN 0 THEN 'icmp' WHEN 1 THEN 'icmp' ELSE 'tcp' END AS k, dst_port <> 0 AS ported,
          CASE WHEN src_ip IN ('10.0.0.1', '10.0.0.2', '10.0.0.3', '10.0.0.4', '10.0.0.5') THEN concat('h', right(src_ip, 1)) ELSE 'unknown' END AS host
        FROM flows)"""


def _rules(spark, folder, keep=("flow_id",)):
    return rules.rules_from_predictions(adapters.flows(spark, folder), list(keep), "label", dpid=2)


@query(
    "mitigation_rules",
    """SELECT DISTINCT command_type, description, priority, rule_json FROM ("""
    + _RULE_SQL.replace('"dpid": 2', '"dpid": 1').replace("dst_port <> 0 AS ported", "dst_port > 1023 AS ported").replace(
        "FROM flows)", "FROM (SELECT * REPLACE (CASE WHEN dst_port > 1023 THEN dst_port END AS dst_port) FROM flows))")
    + ")",
    "flows",
)
def mitigation_rules(spark, folder):
    """Rules for every source seen; well-known ports are left out, so host rules occur too."""
    flows = adapters.flows(spark, folder)
    port = F.when(F.col("dst_port") > 1023, F.col("dst_port"))
    made = rules.mitigation_rules(
        flows, [], F.col("src_ip"), rules.protocol_text(F.col("protocol")), port, F.lit(1)
    )
    return made.select("command_type", "description", "priority", "rule_json").dropDuplicates()


@query(
    "rules_from_predictions",
    f"SELECT flow_id, command_type, description, priority, rule_json FROM ({_RULE_SQL}) WHERE label <> 'Benign'",
    "flows",
)
def rules_from_predictions(spark, folder):
    return _rules(spark, folder).select("flow_id", "command_type", "description", "priority", "rule_json")


_FALLBACK = """[{'command_type': 'block_host', 'description': concat('Proven fallback: Block all traffic from ', ip), 'priority': 100,
    'command': concat('curl -X POST http://localhost:8080/stats/flowentry/add -d ''{"dpid": 1, "priority": 100, "match": {"ipv4_src": "', ip, '", "eth_type": 2048}, "actions": []}''')},
   {'command_type': 'block_icmp', 'description': concat('Proven fallback: Block ICMP from ', ip), 'priority': 100,
    'command': concat('curl -X POST http://localhost:8080/stats/flowentry/add -d ''{"dpid": 1, "priority": 100, "match": {"eth_type": 2048, "ip_proto": 1, "ipv4_src": "', ip, '"}, "actions": []}''')}]"""

_PARSED_SQL = f"""WITH p AS (SELECT response_id, regexp_extract(output, 'Src IP:\\s*([0-9.]+[0-9])', 1) AS ip,
      regexp_extract(output, 'curl\\s+-X\\s+POST\\s+http://[^\\s]+\\s+-d\\s+''[^'']+''') AS cmd FROM responses),
    ok AS (SELECT * FROM p WHERE contains(cmd, '"actions": []'))
  SELECT response_id, 'block_host' AS command_type, 'Intelligent mitigation command 1 generated by RAG agent' AS description, 100 AS priority, cmd AS command FROM ok
  UNION ALL
  SELECT response_id, r.command_type, r.description, r.priority, r.command FROM
    (SELECT response_id, unnest({_FALLBACK}) AS r FROM p WHERE NOT contains(cmd, '"actions": []'))"""


@query("parse_responses", _PARSED_SQL, "responses")
def parse_responses(spark, folder):
    out = rules.parse_responses(adapters.responses(spark, folder), "response_id", "output")
    return out.select("response_id", "command_type", "description", "priority", "command")


@query(
    "validate_rules",
    f"""SELECT flow_id, concat_ws(',', CASE WHEN length(description) > 70 AND flow_id % 2 = 0 THEN 'description' END,
          CASE WHEN priority * (flow_id % 500) NOT BETWEEN 1 AND 65535 THEN 'priority' END, CASE WHEN flow_id % 11 = 0 THEN 'dpid' END) AS errors
        FROM ({_RULE_SQL}) WHERE label <> 'Benign'""",
    "flows",
)
def validate_rules(spark, folder):
    """Damaged on purpose: overlong descriptions, priorities out of range, switch id zero."""
    made = _rules(spark, folder).withColumns(
        {
            "description": F.when(
                (F.length("description") > 70) & (F.col("flow_id") % 2 == 0), F.repeat("description", F.lit(4))
            ).otherwise(F.col("description")),
            "priority": F.col("priority") * (F.col("flow_id") % 500),
            "dpid": F.when(F.col("flow_id") % 11 == 0, 0).otherwise(F.col("dpid")),
            "command": rules.command_of(F.col("rule_json")),
        }
    )
    return rules.validate_rules(made).select("flow_id", F.array_join("errors", ",").alias("errors"))


@query(
    "blocked_sources",
    f"SELECT DISTINCT regexp_extract(command, '\"ipv4_src\": \"([^\"]+)\"', 1) AS src_ip FROM ({_PARSED_SQL})",
    "responses",
)
def blocked_sources(spark, folder):
    parsed = rules.parse_responses(adapters.responses(spark, folder), "response_id", "output")
    return rules.blocked_sources(parsed)


@query(
    "blocked_union",
    "SELECT src_ip AS ip FROM flows WHERE label <> 'Benign' UNION SELECT ipv4 FROM hosts WHERE is_blocked",
    "flows hosts",
)
def blocked_union(spark, folder):
    """Newly blocked sources added to the hosts blocked before."""
    newly = _rules(spark, folder).select(F.col("src_ip").alias("ip"))
    before = adapters.hosts(spark, folder).where("is_blocked").select(F.col("ipv4").alias("ip"))
    return newly.union(before).distinct()


@query(
    "mitigation_summary",
    f"""SELECT response_id, concat('Generated ', CAST(count(*) AS VARCHAR), ' mitigation commands:', chr(10),
          string_agg(concat(CAST(n AS VARCHAR), '. ', description, ' (Priority: ', CAST(priority AS VARCHAR), ')', chr(10)), '' ORDER BY n)) AS summary
        FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY command_type) AS n FROM ({_PARSED_SQL})) GROUP BY response_id""",
    "responses",
)
def mitigation_summary(spark, folder):
    parsed = rules.parse_responses(adapters.responses(spark, folder), "response_id", "output")
    return rules.mitigation_summary(parsed, "response_id", ["command_type"])


@query(
    "rule_status",
    """SELECT CAST(count(*) AS BIGINT) AS total_commands, CAST(count(*) FILTER (flow_id % 5 > 1) AS BIGINT) AS success_count,
         CAST(count(*) FILTER (flow_id % 5 <= 1) AS BIGINT) AS failed_count FROM flows WHERE label <> 'Benign'""",
    "flows",
)
def rule_status(spark, folder):
    case = F.col("flow_id") % 5
    status = F.when(case == 0, "failed").when(case == 1, "error").otherwise("success")
    return rules.rule_status(_rules(spark, folder).withColumn("status", status))


@query(
    "rule_sink",
    f"SELECT command_type, priority, rule_json, CAST(count(DISTINCT rule_json) AS BIGINT) AS times_stored FROM ({_RULE_SQL}) WHERE label <> 'Benign' GROUP BY 1, 2, 3",
    "flows",
)
def rule_sink(spark, folder):
    """The same rules delivered in two overlapping batches are stored once."""
    path = fresh_path(spark, "rules")
    made = _rules(spark, folder, ["flow_id"])
    first, _ = sampling.train_test_split(made, "flow_id", 0.5)
    live.append_rules(first, path)
    live.append_rules(made, path)
    stored = spark.read.parquet(path)
    return stored.groupBy("command_type", "priority", "rule_json").agg(F.count(F.lit(1)).alias("times_stored"))


@query(
    "pattern_catalogue",
    f"""SELECT pattern, approach, CAST(count(*) AS BIGINT) AS n_rules FROM
         (SELECT CASE command_type WHEN 'block_icmp' THEN 'Protocol-specific blocking' WHEN 'block_host' THEN 'Source IP blocking' ELSE 'Port-based filtering' END AS pattern,
            CASE command_type WHEN 'block_icmp' THEN 'Block specific protocols (TCP/UDP/ICMP)' WHEN 'block_host' THEN 'Drop all traffic from malicious IP'
              ELSE 'Block traffic to/from specific ports' END AS approach
          FROM ({_RULE_SQL}) WHERE label <> 'Benign') GROUP BY pattern, approach""",
    "flows",
)
def pattern_catalogue(spark, folder):
    used = _rules(spark, folder).withColumn("pattern", rules.pattern_of_command(F.col("command_type")))
    counts = used.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_rules"))
    return rules.pattern_rows(spark).join(counts, "pattern")


@query(
    "threat_context",
    """SELECT flow_id, concat('Threat Type: ', label, chr(10), 'Severity: ', CASE WHEN label = 'Benign' THEN 'Low' ELSE 'High' END, chr(10), 'Source: ML Classification', chr(10),
         'Classification: ', label, chr(10), 'Confidence: Unknown', chr(10), 'Network Sample: Src IP: ', src_ip, ', Dst IP: ', dst_ip, ', Src Port: ', CAST(src_port AS VARCHAR),
         ', Dst Port: ', CAST(dst_port AS VARCHAR), ', Protocol: ', CAST(protocol AS VARCHAR), chr(10),
         'Active Switches: ', CAST((SELECT count(*) FROM switches) AS VARCHAR), chr(10), 'Active Hosts: ', CAST((SELECT count(*) FROM hosts) AS VARCHAR), chr(10),
         'Previously Blocked Hosts: []') AS context FROM flows""",
    "flows switches hosts",
)
def threat_context(spark, folder):
    # Column titles of the sample line.
    titles = {"Src IP": "src_ip", "Dst IP": "dst_ip", "Src Port": "src_port", "Dst Port": "dst_port", "Protocol": "protocol"}
    return adapters.flows(spark, folder).select(
        "flow_id",
        rules.threat_context(
            F.col("label"),
            {title: F.col(c) for title, c in titles.items()},
            F.lit(adapters.switches(spark, folder).count()),
            F.lit(adapters.hosts(spark, folder).count()),
            F.lit("[]"),
        ).alias("context"),
    )


# -- topology ----------------------------------------------------------------------------


@query(
    "topology_nodes",
    """SELECT concat('host_', replace(ipv4, '.', '_')) AS id, 'host' AS type, CASE WHEN is_blocked THEN 'blocked' ELSE 'active' END AS status, host_id FROM hosts
       UNION ALL SELECT concat('switch_', CAST(dpid AS VARCHAR)), 'switch', 'active', host_id FROM hosts""",
    "hosts",
)
def topology_nodes(spark, folder):
    """Topology documents, one per host with its switch, scanned and exploded to nodes."""
    ip = F.replace("ipv4", F.lit("."), F.lit("_"))
    status = F.when(F.col("is_blocked"), "blocked").otherwise("active")
    documents = adapters.hosts(spark, folder).select(
        "host_id",
        F.concat(
            F.lit('{"nodes":[{"id":"host_'), ip, F.lit('","type":"host","status":"'), status,
            F.lit('","ip_address":"'), "ipv4", F.lit('","dpid":null,"blocking_commands":[]},{"id":"switch_'),
            F.col("dpid").cast("string"), F.lit('","type":"switch","status":"active","dpid":'), F.col("dpid").cast("string"),
            F.lit('}],"links":[]}'),
        ).alias("raw_json"),
    )
    parsed = files.parse_topologies(documents, keep=("host_id",))
    return parsed.select("host_id", F.explode("topology.nodes").alias("n")).select("n.id", "n.type", "n.status", "host_id")


@query(
    "host_names",
    """SELECT DISTINCT src_ip AS ip, concat('h', string_split(src_ip, '.')[-1]) AS host_name FROM flows
       UNION SELECT DISTINCT url, concat('host_', replace(url, '.', '_')) FROM pages""",
    "flows",
)
def host_names(spark, folder):
    """Addresses by known name or last octet; anything else by its text."""
    from flowtide.session import table

    seen = adapters.flows(spark, folder).select(F.col("src_ip").alias("ip"))
    odd = table(spark, folder, "pages").select(F.col("url").alias("ip"))
    known = spark.createDataFrame(list(rules.KNOWN_HOSTS.items()), "ipv4 string, name string")
    return topology.with_host_names(seen.union(odd).distinct(), known, "ip")


@query(
    "blocked_hosts",
    "SELECT host_id, ipv4, is_blocked OR ipv4 IN (SELECT src_ip FROM flows WHERE label <> 'Benign') AS is_blocked FROM hosts",
    "hosts flows",
)
def blocked_hosts(spark, folder):
    hosts = adapters.hosts(spark, folder)
    by_rule = _rules(spark, folder).select(F.col("src_ip").alias("ipv4"))
    blocked = by_rule.union(hosts.where("is_blocked").select("ipv4"))
    return topology.with_blocked_flag(hosts.select("host_id", "ipv4"), blocked)


@query(
    "host_ports",
    """SELECT dpid, port_no, ipv4, concat('00:00:00:00:00:0', CAST(row_number() OVER (ORDER BY dpid, port_no, port_name) AS VARCHAR)) AS mac FROM
       (SELECT h.dpid, h.port_no, concat('s', CAST(h.dpid AS VARCHAR), '-eth', CAST(h.port_no AS VARCHAR), '-', CAST(h.host_id AS VARCHAR)) AS port_name,
          CASE WHEN h.port_no = 1 AND h.dpid IN (1, 2, 3) THEN concat('10.0.0.', CAST(h.dpid AS VARCHAR))
            ELSE concat('10.0.', CAST(h.dpid AS VARCHAR), '.', CAST(h.port_no AS VARCHAR)) END AS ipv4
        FROM hosts h JOIN switches s ON h.dpid = s.dpid WHERE h.port_no = 1)""",
    "hosts switches",
)
def host_ports(spark, folder):
    name = F.concat(
        F.lit("s"), F.col("dpid").cast("string"), F.lit("-eth"), F.col("port_no").cast("string"), F.lit("-"), F.col("host_id").cast("string")
    )
    ports = adapters.hosts(spark, folder).select("dpid", "port_no", name.alias("port_name"))
    out = topology.host_ports(ports, adapters.switches(spark, folder))
    return out.withColumns({"dpid": F.col("dpid").cast("int"), "port_no": F.col("port_no").cast("int")})


@query(
    "linear_links",
    "SELECT dpid, next_dpid FROM (SELECT dpid, lead(dpid) OVER (ORDER BY dpid) AS next_dpid FROM switches) WHERE next_dpid IS NOT NULL",
    "switches",
)
def linear_links(spark, folder):
    return topology.linear_links(adapters.switches(spark, folder))


@query(
    "topology_graph",
    """SELECT 'node' AS part, concat('switch_', CAST(dpid AS VARCHAR)) AS id, 'switch' AS kind, 'active' AS status, NULL AS source, NULL AS target FROM switches
       UNION ALL SELECT 'node', concat('host_', replace(ipv4, '.', '_')), 'host', CASE WHEN is_blocked THEN 'blocked' ELSE 'active' END, NULL, NULL FROM hosts
       UNION ALL SELECT 'link', concat('link_host_', replace(ipv4, '.', '_'), '_switch_', CAST(dpid AS VARCHAR)), 'link', 'active', concat('host_', replace(ipv4, '.', '_')), concat('switch_', CAST(dpid AS VARCHAR)) FROM hosts
       UNION ALL SELECT 'link', concat('link_switch_', CAST(dpid AS VARCHAR), '_switch_', CAST(n AS VARCHAR)), 'link', 'active', concat('switch_', CAST(dpid AS VARCHAR)), concat('switch_', CAST(n AS VARCHAR))
         FROM (SELECT dpid, lead(dpid) OVER (ORDER BY dpid) AS n FROM switches) WHERE n IS NOT NULL""",
    "switches hosts",
)
def topology_graph(spark, folder):
    switches, hosts = adapters.switches(spark, folder), adapters.hosts(spark, folder)
    text = F.lit(None).cast("string")
    nodes = topology.topology_nodes(switches, hosts).select(
        F.lit("node").alias("part"), "id", F.col("type").alias("kind"), "status", text.alias("source"), text.alias("target")
    )
    links = topology.topology_links(switches, hosts).select(
        F.lit("link").alias("part"), "id", F.lit("link").alias("kind"), "status", "source", "target"
    )
    return nodes.unionByName(links)


@query(
    "topology_stats",
    """SELECT CAST((SELECT count(*) FROM switches) + (SELECT count(*) FROM hosts) AS BIGINT) AS total_nodes,
         CAST((SELECT count(*) FROM hosts) + (SELECT count(*) FROM switches) - 1 AS BIGINT) AS total_links,
         CAST((SELECT count(*) FROM hosts WHERE is_blocked) AS BIGINT) AS blocked_hosts,
         CAST((SELECT count(*) FROM flows WHERE label <> 'Benign') AS BIGINT) AS applied_commands""",
    "switches hosts flows",
)
def topology_stats(spark, folder):
    switches, hosts = adapters.switches(spark, folder), adapters.hosts(spark, folder)
    return topology.topology_stats(
        topology.topology_nodes(switches, hosts), topology.topology_links(switches, hosts), _rules(spark, folder)
    )


@query(
    "mac_table",
    "SELECT dpid, src, arg_max(in_port, (ts, packet_id)) AS port FROM packets GROUP BY dpid, src",
    "packets",
)
def mac_table(spark, folder):
    return topology.mac_table(adapters.packets(spark, folder))


@query(
    "asof_forwarding",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, packet_id) AS n FROM packets)
       SELECT p.packet_id, coalesce(CAST(arg_max(o.in_port, o.n) AS VARCHAR), 'FLOOD') AS out_port
       FROM r p LEFT JOIN r o ON o.dpid = p.dpid AND o.src = p.dst AND o.n <= p.n GROUP BY p.packet_id""",
    "packets",
)
def asof_forwarding(spark, folder):
    return topology.asof_forwarding(adapters.packets(spark, folder))
