"""Firewall rules as rows. Rules are generated, mined, checked and stored, never executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Host names, protocol numbers, priorities, patterns and texts of rule rows.
KNOWN_HOSTS = {"10.0.0.1": "h1", "10.0.0.2": "h2", "10.0.0.3": "h3", "10.0.0.4": "h4", "10.0.0.5": "h5"}
PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1}
HOST_PRIORITY = 100
PORT_PRIORITY = 200
DEFAULT_SOURCE = "10.0.0.1"
RULE_ENDPOINT = "http://localhost:8080/stats/flowentry/add"
STRICT_COMMAND = r"curl\s+-X\s+POST\s+http://[^\s]+\s+-d\s+'[^']+'"
RELAXED_COMMAND = r"curl[^`\n]*flowentry/add[^`\n]*"
REQUIRED_PARTS = ["curl", "-X POST", "http://", "flowentry/add", "-d"]
PROSE_PARTS = ["command adds", "this will", "to drop", "traffic from", "on port"]
PASSING_ACTIONS = ['"OUTPUT"', '"METER"', '"NORMAL"']
MIN_COMMAND_CHARS = 50
MITIGATION_PATTERNS = {
    "Source IP blocking": "Drop all traffic from malicious IP",
    "Protocol-specific blocking": "Block specific protocols (TCP/UDP/ICMP)",
    "Port-based filtering": "Block traffic to/from specific ports",
    "Rate limiting": "Limit packet rate from suspicious sources",
    "Traffic redirection": "Redirect suspicious traffic for analysis",
    "VLAN isolation": "Isolate compromised hosts to separate VLAN",
    "Quality of Service (QoS)": "Downgrade priority of suspicious traffic",
    "Geographic blocking": "Block traffic from specific geographic regions",
}
PATTERN_OF_COMMAND = {
    "block_host": "Source IP blocking",
    "block_icmp": "Protocol-specific blocking",
    "block_protocol": "Protocol-specific blocking",
    "block_tcp_port": "Port-based filtering",
    "block_udp_port": "Port-based filtering",
    "block_port": "Port-based filtering",
}


def _text(column: Column) -> Column:
    return column.cast("string")


def known_host(ip: Column) -> Column:
    chain = None
    for address, name in KNOWN_HOSTS.items():
        chain = F.when(ip == address, name) if chain is None else chain.when(ip == address, name)
    return chain


def host_name(ip: Column) -> Column:
    """Known name, else ``h`` and the last part as a number, else ``host_`` and the address."""
    last = F.element_at(F.split(ip, r"\."), -1).try_cast("bigint")
    return F.coalesce(
        known_host(ip), F.concat(F.lit("h"), _text(last)), F.concat(F.lit("host_"), F.replace(ip, F.lit("."), F.lit("_")))
    )


def command_of(rule_json: Column) -> Column:
    """The request text that would install a rule."""
    return F.concat(F.lit(f"curl -X POST {RULE_ENDPOINT} -d '"), rule_json, F.lit("'"))


def _rule_json(dpid: Column, priority: Column, match: Column) -> Column:
    return F.concat(
        F.lit('{"dpid": '), _text(dpid), F.lit(', "priority": '), _text(priority),
        F.lit(', "match": {'), match, F.lit('}, "actions": []}'),
    )


def mitigation_rules(
    df: DataFrame, keep: list[str], src_ip: Column, protocol: Column, dst_port: Column, dpid: Column
) -> DataFrame:
    """One rule per row: ICMP from a source, a TCP/UDP port from a source, or the whole source."""
    kind = F.lower(F.coalesce(protocol, F.lit("tcp")))
    ported = kind.isin("tcp", "udp") & dst_port.isNotNull() & (dst_port != 0)
    host = F.coalesce(known_host(src_ip), F.lit("unknown"))
    number = F.when(kind == "udp", PROTOCOL_NUMBERS["udp"]).otherwise(PROTOCOL_NUMBERS["tcp"])
    chosen = df.select(
        *keep,
        src_ip.alias("__src"), kind.alias("__kind"), ported.alias("__ported"), host.alias("__host"),
        number.alias("__number"), dst_port.cast("int").alias("__port"), dpid.cast("int").alias("dpid"),
    )
    k, src, at = F.col("__kind"), F.col("__src"), F.col("__port")
    icmp = k == "icmp"
    has_port = F.col("__ported")
    whom = F.concat(F.col("__host"), F.lit(" ("), src, F.lit(")"))
    source_pair = F.concat(F.lit('"ipv4_src": "'), src, F.lit('"'))
    match = (
        F.when(icmp, F.concat(F.lit('"eth_type": 2048, "ip_proto": 1, '), source_pair))
        .when(
            has_port,
            F.concat(
                F.lit('"eth_type": 2048, "ip_proto": '), _text(F.col("__number")), F.lit(', "'), k, F.lit('_dst": '),
                _text(at), F.lit(", "), source_pair,
            ),
        )
        .otherwise(F.concat(source_pair, F.lit(', "eth_type": 2048')))
    )
    priority = F.when(~icmp & has_port, PORT_PRIORITY).otherwise(HOST_PRIORITY)
    return chosen.select(
        *keep,
        F.when(icmp, "block_icmp").when(has_port, F.concat(F.lit("block_"), k, F.lit("_port"))).otherwise("block_host").alias("command_type"),
        F.when(icmp, F.concat(F.lit("Block ICMP (ping) from "), whom))
        .when(has_port, F.concat(F.lit("Block "), F.upper(k), F.lit(" traffic to port "), _text(at), F.lit(" from "), whom))
        .otherwise(F.concat(F.lit("Block all traffic from host "), whom))
        .alias("description"),
        _rule_json(F.col("dpid"), priority, match).alias("rule_json"),
        priority.alias("priority"),
        "dpid",
        src.alias("src_ip"),
    )


def protocol_text(number: Column, icmp_codes: tuple[int, ...] = (1, 0)) -> Column:
    """Protocol name of a flow record; ICMP is recognised under either recorded number."""
    return F.when(number == 17, "udp").when(number.isin(*icmp_codes), "icmp").otherwise("tcp")


def rules_from_predictions(
    df: DataFrame, keep: list[str], prediction: str = "prediction", dpid: int = 1, icmp_codes: tuple[int, ...] = (1, 0)
) -> DataFrame:
    """Rules for rows predicted malicious, from the flow's own fields."""
    return mitigation_rules(
        df.where(F.col(prediction) != "Benign"),
        keep,
        F.col("src_ip"),
        protocol_text(F.col("protocol"), icmp_codes),
        F.col("dst_port").try_cast("int"),
        F.lit(dpid),
    )


def _has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def valid_command(command: Column) -> Column:
    """A complete request, not prose about one, that drops traffic instead of passing it."""
    ok = F.lit(True)
    for part in REQUIRED_PARTS:
        ok = ok & _has(command, part)
    low = F.lower(command)
    for part in PROSE_PARTS:
        ok = ok & ~_has(low, part)
    passing = _has(command, PASSING_ACTIONS[0])
    for action in PASSING_ACTIONS[1:]:
        passing = passing | _has(command, action)
    return ok & (_has(command, '"actions": []') | (~passing & _has(command, '"actions"')))


def parse_responses(df: DataFrame, response_id: str, output: str, fallback: bool = True) -> DataFrame:
    """Rules mined from recorded responses, two standard rules where a response has none.

    Everything is decided within the response's own row; no join or regrouping is needed.
    """
    text = F.coalesce(F.col(output), F.lit(""))
    strict = F.regexp_extract_all(text, F.lit(STRICT_COMMAND), F.lit(0))
    relaxed = F.filter(
        F.regexp_extract_all(text, F.lit(RELAXED_COMMAND), F.lit(0)),
        lambda c: _has(c, "-X POST") & _has(c, "-d") & _has(c, "http://"),
    )
    found = F.when(F.size(strict) > 0, strict).otherwise(relaxed)
    numbered = F.transform(found, lambda c, i: F.struct(i.alias("i"), F.trim(c).alias("command"), valid_command(c).alias("ok")))
    usable = F.filter(
        numbered, lambda c: c["ok"] & (F.length(c["command"]) >= MIN_COMMAND_CHARS)
    )
    mined = F.transform(
        usable,
        lambda c: F.struct(
            F.when(_has(c["command"], "ipv4_src"), "block_host")
            .when(_has(c["command"], "tcp_dst") | _has(c["command"], "udp_dst"), "block_port")
            .when(_has(c["command"], "ip_proto"), "block_protocol")
            .otherwise("intelligent_mitigation")
            .alias("command_type"),
            F.concat(F.lit("Intelligent mitigation command "), _text(c["i"] + 1), F.lit(" generated by RAG agent")).alias("description"),
            c["command"].alias("command"),
            (c["i"] + 100).alias("priority"),
            F.lit(1).alias("dpid"),
        ),
    )
    named = F.regexp_extract(text, r"Src IP:\s*([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)", 1)
    src = F.when(named != "", named).otherwise(DEFAULT_SOURCE)
    pair = F.concat(F.lit('"ipv4_src": "'), src, F.lit('"'))
    standard = F.array(
        F.struct(
            F.lit("block_host").alias("command_type"),
            F.concat(F.lit("Proven fallback: Block all traffic from "), src).alias("description"),
            command_of(_rule_json(F.lit(1), F.lit(100), F.concat(pair, F.lit(', "eth_type": 2048')))).alias("command"),
            F.lit(100).alias("priority"),
            F.lit(1).alias("dpid"),
        ),
        F.struct(
            F.lit("block_icmp").alias("command_type"),
            F.concat(F.lit("Proven fallback: Block ICMP from "), src).alias("description"),
            command_of(_rule_json(F.lit(1), F.lit(100), F.concat(F.lit('"eth_type": 2048, "ip_proto": 1, '), pair))).alias("command"),
            F.lit(100).alias("priority"),
            F.lit(1).alias("dpid"),
        ),
    )
    rows = df.select(response_id, mined.alias("__mined"), standard.alias("__standard"))
    chosen = F.when(F.size("__mined") > 0, F.col("__mined")).otherwise(F.col("__standard")) if fallback else F.col("__mined")
    # The outer form keeps the mined arrays from being computed twice, once for a size filter.
    return rows.select(response_id, F.inline_outer(chosen)).where(F.col("command_type").isNotNull())


def without_response(df: DataFrame, keep: list[str], src_ip: Column, dpid: int = 1) -> DataFrame:
    """The one rule used when no response was recorded at all: block the source."""
    return mitigation_rules(df, keep, F.coalesce(src_ip, F.lit(DEFAULT_SOURCE)), F.lit("tcp"), F.lit(None).cast("int"), F.lit(dpid))


def validate_rules(df: DataFrame, command: str = "command") -> DataFrame:
    """Add ``errors`` (constraint names) and ``valid``."""
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    checks = {
        "command_type": length("command_type").between(3, 50),
        "description": length("description").between(10, 200),
        command: length(command) >= MIN_COMMAND_CHARS,
        "priority": F.coalesce(F.col("priority").between(1, 65535), F.lit(False)),
        "dpid": F.coalesce(F.col("dpid") >= 1, F.lit(False)),
    }
    errors = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def validate_products(df: DataFrame) -> DataFrame:
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    checks = {
        "name": length("name").between(2, 100),
        "type": length("type").between(3, 100),
        "description": length("description").between(50, 500),
        "relevance_score": F.coalesce(F.col("relevance_score").between(0, 10), F.lit(False)),
    }
    errors = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def blocked_sources(df: DataFrame, command: str = "command") -> DataFrame:
    """Distinct source addresses named by rules."""
    source = F.regexp_extract(command, r'"ipv4_src": "([^"]+)"', 1)
    return df.select(source.alias("src_ip")).where(F.col("src_ip") != "").distinct()


def rule_key(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def mitigation_summary(rules: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Numbered text of the rules of each sample (a sample has a handful of rules)."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "description", "priority")))
    numbered = F.transform(
        "__rules",
        lambda r, i: F.concat(
            _text(i + 1), F.lit(". "), r["description"], F.lit(" (Priority: "), _text(r["priority"]), F.lit(")\n")
        ),
    )
    return (
        rules.groupBy(group)
        .agg(listed.alias("__rules"))
        .select(
            group,
            F.concat(
                F.lit("Generated "), _text(F.size("__rules")), F.lit(" mitigation commands:\n"), F.array_join(numbered, "")
            ).alias("summary"),
        )
    )


def rule_status(rules: DataFrame, status: str = "status") -> DataFrame:
    """Totals of a rule run."""
    return rules.agg(
        F.count(F.lit(1)).alias("total_commands"),
        F.count_if(F.col(status) == "success").alias("success_count"),
        F.count_if(F.col(status) != "success").alias("failed_count"),
    )


def threat_context(
    prediction: Column, sample: dict[str, Column], switches: Column, hosts: Column, blocked: Column
) -> Column:
    """The text that describes one threat and the network around it."""
    severity = F.when(prediction != "Benign", "High").otherwise("Low")
    parts = [F.concat(F.lit(f"{name}: "), _text(value)) for name, value in sample.items()]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Threat Type: "), prediction),
        F.concat(F.lit("Severity: "), severity),
        F.lit("Source: ML Classification"),
        F.concat(F.lit("Classification: "), prediction),
        F.lit("Confidence: Unknown"),
        F.concat(F.lit("Network Sample: "), F.concat_ws(", ", *parts)),
        F.concat(F.lit("Active Switches: "), _text(switches)),
        F.concat(F.lit("Active Hosts: "), _text(hosts)),
        F.concat(F.lit("Previously Blocked Hosts: "), blocked),
    )


def pattern_rows(spark) -> DataFrame:
    """The catalogue of mitigation patterns."""
    return spark.createDataFrame(list(MITIGATION_PATTERNS.items()), "pattern string, approach string")


def pattern_of_command(command_type: Column) -> Column:
    chain = None
    for name, pattern in PATTERN_OF_COMMAND.items():
        chain = F.when(command_type == name, pattern) if chain is None else chain.when(command_type == name, pattern)
    return chain
