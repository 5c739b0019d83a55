"""Golden rows of scalar expressions, rules, votes and parsers."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowtide.functions import flow, text, timing
from flowtide.operators import live, rules, topology, voting
from flowtide.sources import files


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_port_category(spark):
    ports = [80, 8080, 443, 22, 53, 587, 465, 25, 21, 5432, 3306, 1000, 0, 49152, 65535, 30000, -1, None]
    want = ["HTTP", "HTTP", "HTTPS", "SSH", "DNS", "SMTP", "SMTP", "SMTP", "FTP", "DB", "DB", "Well-Known", "Well-Known", "Ephemeral", "Ephemeral", "Other", "Other", None]
    assert column(spark, ports, "int", flow.port_category) == want


def test_protocol_category(spark):
    assert column(spark, [6, 17, 0], "int", flow.protocol_category) == ["TCP", "UDP", "HOPOPT"]
    with pytest.raises(Exception, match="1 is not a supported protocol number"):
        column(spark, [1], "int", flow.protocol_category)
    assert column(spark, [1], "int", lambda c: flow.protocol_category(c, "other")) == ["Other"]


def test_timestamps(spark):
    texts = ["11/10/2023 01:02:03 PM", "10/30/2023 01:02:03 PM", "2023-11-10 13:02:03", "30/10/2023 08:05", "", "nonsense", None]
    want = [
        dt.datetime(2023, 10, 11, 13, 2, 3), dt.datetime(2023, 10, 30, 13, 2, 3), dt.datetime(2023, 11, 10, 13, 2, 3),
        dt.datetime(2023, 10, 30, 8, 5), None, None, None,
    ]
    shown = column(spark, texts, "string", lambda c: F.date_format(timing.parse_timestamp(c), "yyyy-MM-dd HH:mm:ss"))
    assert shown == [w.strftime("%Y-%m-%d %H:%M:%S") if w else None for w in want]


def test_event_micros_ignores_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.000001' AS ts")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(timing.event_micros(df, "ts").alias("us")).first()["us"] == 1711852200000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_ipv4(spark):
    got = column(spark, ["10.0.0.1", "256.1.1.1", "1.2.3", "01.2.3.4", None, "x"], "string", flow.ipv4_or_default)
    assert got == ["10.0.0.1"] + ["0.0.0.0"] * 5


def poll(*entries):
    return json.dumps({"3": list(entries)})


def test_live_flows_golden(spark):
    icmp = {"match": {"nw_src": "10.0.0.9", "nw_proto": "1", "tp_dst": "5"}, "duration_sec": 2, "duration_nsec": 500000000, "packet_count": 10, "byte_count": 1000}
    idle = {"match": {"ipv4_src": "10.0.0.1", "ip_proto": "6", "tcp_dst": "22", "tcp_src": "0", "tp_src": "9"}, "duration_sec": 0, "byte_count": 5}
    other = {"match": {"in_port": "1"}, "duration_sec": 1}
    polls = spark.createDataFrame([(poll(icmp, idle, other),), ("{broken",), ("{}",)], "raw_json string")
    rows = {r["src_ip"]: r for r in live.live_flows(polls).collect()}
    assert set(rows) == {"10.0.0.9", "10.0.0.1"}
    a, b = rows["10.0.0.9"], rows["10.0.0.1"]
    assert (a["protocol"], a["dst_port"], a["src_port"], a["flow_duration"], a["flow_bytes_s"], a["flow_packets_s"]) == (0, 0.0, 0.0, 2_500_000.0, 400.0, 4.0)
    assert (b["protocol"], b["dst_port"], b["src_port"], b["flow_bytes_s"], b["dst_ip"]) == (6, 22.0, 9.0, 0.0, "0.0.0.0")
    assert a["label"] == "Unknown" and a["dpid"] == 3 and a["ts"] is not None
    assert [r["raw_json"] for r in files.bad_polls(polls).collect()] == ["{broken"]


def test_no_polls(spark):
    empty = spark.createDataFrame([], "raw_json string")
    out = live.live_flows(empty)
    assert out.count() == 0 and "flow_bytes_s" in out.columns


CASES = [
    ("10.0.0.1", None, None, ("block_host", 100, {"ipv4_src": "10.0.0.1", "eth_type": 2048})),
    ("10.0.0.1", "tcp", 22, ("block_tcp_port", 200, {"eth_type": 2048, "ip_proto": 6, "tcp_dst": 22, "ipv4_src": "10.0.0.1"})),
    ("10.0.0.1", "icmp", None, ("block_icmp", 100, {"eth_type": 2048, "ip_proto": 1, "ipv4_src": "10.0.0.1"})),
    ("10.0.0.1", "UDP", 80, ("block_udp_port", 200, {"eth_type": 2048, "ip_proto": 17, "udp_dst": 80, "ipv4_src": "10.0.0.1"})),
    ("10.0.0.1", "sctp", 80, ("block_host", 100, {"ipv4_src": "10.0.0.1", "eth_type": 2048})),
]


@pytest.mark.parametrize(("src", "protocol", "port", "want"), CASES)
def test_rule_choice(spark, src, protocol, port, want):
    df = spark.createDataFrame([(src, protocol, port)], "s string, p string, d int")
    row = rules.mitigation_rules(df, [], F.col("s"), F.col("p"), F.col("d"), F.lit(1)).first()
    document = json.loads(row["rule_json"])
    assert (row["command_type"], row["priority"], document["match"]) == want
    assert document["actions"] == [] and document["priority"] == row["priority"] and "h1 (10.0.0.1)" in row["description"]


def test_rules_from_predictions(spark):
    df = spark.createDataFrame(
        [("10.0.0.2", 443, 6, "DDoS Attack"), ("10.0.0.3", 0, 0, "ICMP Flood"), ("10.0.0.4", 53, 17, "Benign")],
        "src_ip string, dst_port int, protocol int, prediction string",
    )
    rows = rules.rules_from_predictions(df, [], dpid=2).orderBy("src_ip").collect()
    assert [r["command_type"] for r in rows] == ["block_tcp_port", "block_icmp"]
    assert '"tcp_dst": 443' in rows[0]["rule_json"] and rows[0]["dpid"] == 2


def test_parse_responses(spark):
    good = "curl -X POST http://h/stats/flowentry/add -d '{\"match\": {\"ip_proto\": 1}, \"actions\": []}'"
    passing = "curl -X POST http://h/stats/flowentry/add -d '{\"actions\": [\"OUTPUT\"]}'"
    loose = 'run curl -X POST "http://h/stats/flowentry/add" -d {"tcp_dst": 1, "actions": []} now'
    texts = [f"{passing}\nthen {good}", loose, "Src IP:  10.9.8.7 no command", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, output string")
    rows = rules.parse_responses(df, "i", "output").orderBy("i", "command_type").collect()
    assert [(r["i"], r["command_type"], r["priority"]) for r in rows] == [
        (0, "block_protocol", 101), (1, "block_port", 100), (2, "block_host", 100), (2, "block_icmp", 100),
        (3, "block_host", 100), (3, "block_icmp", 100), (4, "block_host", 100), (4, "block_icmp", 100),
    ]
    assert "10.9.8.7" in rows[2]["command"] and "10.0.0.1" in rows[4]["command"]


def test_host_names(spark):
    assert column(spark, ["10.0.0.3", "10.0.0.77", "x.y", "10.0.0.077"], "string", rules.host_name) == ["h3", "h77", "host_x_y", "h77"]


def test_summary(spark):
    df = spark.createDataFrame([(1, 1, "Block a", 100), (1, 2, "Block b", 200)], "g int, n int, description string, priority int")
    row = rules.mitigation_summary(df, "g", ["n"]).first()
    assert row["summary"] == "Generated 2 mitigation commands:\n1. Block a (Priority: 100)\n2. Block b (Priority: 200)\n"


@pytest.mark.parametrize(
    ("votes", "majority", "low", "ratio"),
    [((1, 1, 2, 2), 1, True, 50.0), ((3, 1, 1, 2), 1, False, 50.0), ((4, 3, 2, 1), 4, True, 25.0), ((2, 2, 2, 1), 2, False, 75.0), ((5, 5, 5, 5), 5, False, 100.0)],
)
def test_hard_vote(spark, votes, majority, low, ratio):
    row = voting.hard_vote(spark.createDataFrame([votes], "rfc int, xgb int, mlp int, knn int")).first()
    assert (row["majority"], row["low_agreement"], row["agreement_ratio"]) == (majority, low, ratio)


def cve(metrics, lang="en", cve_id="CVE-2024-12345"):
    return json.dumps({"cve": {"id": cve_id, "descriptions": [{"lang": lang, "value": "text"}], "metrics": metrics}})


def test_cve_variants(spark):
    def v2(score):
        return {"cvssMetricV2": [{"cvssData": {"baseScore": score}}]}

    documents = [cve(v2(7.0)), cve(v2(4.0)), cve(v2(3.9)), cve({}, "fr"), cve({}, cve_id="BAD"), cve({"cvssMetricV31": [{"cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}]})]
    df = files.parse_cve_feed(spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, raw_json string"))
    a = {r["i"]: (r["severity"], r["score"], r["description"]) for r in text.cve_rows(df, ["i"], "A").collect()}
    assert a == {
        0: ("HIGH", "7.0", "text"), 1: ("MEDIUM", "4.0", "text"), 2: ("LOW", "3.9", "text"),
        3: ("UNKNOWN", "N/A", "No description available"), 5: ("CRITICAL", "9.8", "text"),
    }
    b = {r["i"]: (r["severity"], r["score"]) for r in text.cve_rows(df, ["i"], "B").collect()}
    assert b == {0: ("N/A", "7.0"), 1: ("N/A", "4.0"), 2: ("N/A", "3.9"), 5: ("CRITICAL", "9.8")}


def test_mentions(spark):
    body = "Intro. CVE-2024-12345 is bad! It is remote code execution. Then CVE-2024-1234 and CVE-2024-12345 again"
    df = spark.createDataFrame([(1, body), (2, "nothing")], "i int, t string")
    rows = text.mine_mentions(df, "t", F.lit("flood")).orderBy("ordinal").collect()
    assert [(r["mention"], r["start"], r["severity"]) for r in rows] == [
        ("CVE-2024-12345", body.index("CVE-2024-12345"), "CRITICAL"), ("CVE-2024-1234", body.index("CVE-2024-1234 "), "CRITICAL"),
    ]
    assert rows[0]["description"] == "CVE-2024-12345 is bad. It is remote code execution"
    assert rows[0]["url"].endswith("CVE-2024-12345") and rows[0]["score"] == "9.0-10.0"


def test_relevance(spark):
    df = spark.createDataFrame([("Snort IDS", "IDS", "enterprise ids", "ids")], "n string, t string, d string, q string")
    assert df.select(text.product_relevance(*[F.col(c) for c in "ntdq"]).alias("s")).first()["s"] == 8


def test_clean_for_relevance(spark):
    texts = ["é✓ Final Prediction:  DDoS (high)\nmore", "  first <line>\nsecond", None, ""]
    assert column(spark, texts, "string", text.clean_for_relevance) == ["DDoS high", "first line", "", ""]


def test_chunks(spark):
    body = "".join(chr(97 + i % 26) for i in range(1000))
    rows = text.chunk_text(spark.createDataFrame([(1, body), (2, "")], "i int, t string"), "t", ["i"]).orderBy("chunk_no").collect()
    assert [r["chunk"] for r in rows] == [body[0:500], body[450:950], body[900:1000]]


def test_sample_topology_document(spark):
    nodes = [{"id": f"switch_{i}", "type": "switch", "status": "active", "dpid": i} for i in (1, 2, 3)]
    nodes += [{"id": f"host_h{i}", "type": "host", "status": "blocked" if i == 1 else "active", "ip_address": f"10.0.0.{i}"} for i in range(1, 6)]
    links = [{"id": f"l{i}", "source": "a", "target": "b", "status": "active"} for i in range(7)]
    documents = spark.createDataFrame([(json.dumps({"nodes": nodes, "links": links}),)], "raw_json string")
    parsed = files.parse_topologies(documents)
    n = parsed.select(F.explode("topology.nodes").alias("n")).select("n.*")
    li = parsed.select(F.explode("topology.links").alias("l")).select("l.*")
    applied = spark.createDataFrame([("block",)], "command_type string")
    assert tuple(topology.topology_stats(n, li, applied).first()) == (8, 7, 1, 1)


def test_default_hosts_only_when_none_found(spark):
    switches = spark.createDataFrame([(1,), (3,)], "dpid int")
    ports = spark.createDataFrame([(1, 7, "s1-eth7")], "dpid int, port_no long, port_name string")
    got = topology.host_ports(ports, switches).orderBy("dpid").collect()
    assert [(r["dpid"], r["ipv4"], r["mac"]) for r in got] == [(1, "10.0.0.1", "00:00:00:00:00:01"), (3, "10.0.0.3", "00:00:00:00:00:02")]
    found = spark.createDataFrame([(3, 1, "s3-eth1"), (3, 4294967294, "s3-eth1"), (9, 1, "s9-eth1")], "dpid int, port_no long, port_name string")
    assert [(r["dpid"], r["ipv4"]) for r in topology.host_ports(found, switches).collect()] == [(3, "10.0.0.3")]
