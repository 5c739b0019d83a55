"""The adapter views as portable SQL, prepended as CTEs to the checking queries."""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["flows"] = """
SELECT event_id AS flow_id, ts,
  concat('10.0.', CAST(CAST(floor(user_id / 250) AS INT) AS VARCHAR(9)), '.', CAST(user_id % 250 + 1 AS VARCHAR(9))) AS src_ip,
  concat('10.1.0.', CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 20 + 1 AS VARCHAR(9))) AS dst_ip,
  CAST(1024 + event_id % 64000 AS INT) AS src_port,
  CASE CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 12
    WHEN 0 THEN 80 WHEN 1 THEN 8080 WHEN 2 THEN 443 WHEN 3 THEN 22 WHEN 4 THEN 53 WHEN 5 THEN 25
    WHEN 6 THEN 587 WHEN 7 THEN 21 WHEN 8 THEN 3306 WHEN 9 THEN 1000 WHEN 10 THEN 50000 ELSE 30000 END AS dst_port,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 17 ELSE 6 END AS protocol,
  value * 1000 AS flow_duration, value * 100 AS flow_bytes_s, value AS flow_packets_s,
  CASE event_type WHEN 'view' THEN 'Benign' WHEN 'error' THEN 'DNS Flood' WHEN 'signup' THEN 'ICMP Flood'
    WHEN 'purchase' THEN 'Dictionary Attack' ELSE 'Port Scan' END AS label
FROM events
"""

VIEWS["votes"] = """
SELECT vec_id AS row_id, label % 4 AS truth, label % 4 AS rfc,
  CAST((label + vec_id % 2) % 4 AS INT) AS xgb, CAST((label + vec_id % 3) % 4 AS INT) AS mlp,
  CAST((label + vec_id % 5) % 4 AS INT) AS knn
FROM embeddings
"""

VIEWS["scores"] = """
SELECT v.row_id, c.class_id, v.truth, CAST((v.row_id * 37 + c.class_id * 11) % 101 AS DOUBLE) / 101 AS score
FROM votes v CROSS JOIN (SELECT DISTINCT label % 4 AS class_id FROM embeddings) c
"""

VIEWS["hosts"] = """
SELECT s_suppkey AS host_id, concat('10.0.', CAST(s_nationkey AS VARCHAR(9)), '.', CAST(s_suppkey % 250 + 1 AS VARCHAR(9))) AS ipv4,
  s_nationkey + 1 AS dpid, CAST(s_suppkey % 4 + 1 AS INT) AS port_no, s_acctbal < 0 AS is_blocked
FROM supplier
"""

VIEWS["switches"] = """
SELECT n_nationkey + 1 AS dpid, n_name AS switch_name FROM nation
"""

VIEWS["products"] = """
SELECT p_partkey AS product_id, p_name AS name, p_type AS type,
  concat(p_name, CASE WHEN p_size % 3 = 0 THEN ' for enterprise networks' ELSE ' appliance' END) AS description
FROM part
"""

VIEWS["flow_stats"] = """
SELECT flow_id, concat('{"match":{', CASE WHEN flow_id % 2 = 0 THEN concat('"ipv4_src":"', src_ip, '","ipv4_dst":"', dst_ip, '","ip_proto":"', CAST(protocol AS VARCHAR(9)), '","tcp_dst":"', CAST(dst_port AS VARCHAR(9)), '"')
   WHEN flow_id % 7 = 0 THEN '"in_port":"1"'
   ELSE concat('"nw_src":"', src_ip, '","nw_dst":"', dst_ip, '","nw_proto":"1"') END,
   '},"duration_sec":', CAST(flow_id % 5 AS VARCHAR(20)), ',"duration_nsec":', CAST(flow_id % 3 * 500000000 AS VARCHAR(20)),
   ',"packet_count":', CAST(flow_id % 997 AS VARCHAR(20)), ',"byte_count":', CAST(flow_id * 13 AS VARCHAR(20)), '}') AS raw_json
FROM flows
"""

VIEWS["cve_feed"] = """
SELECT doc_id, concat('{"cve":{"id":"', CASE WHEN doc_id % 9 = 0 THEN 'BAD-' ELSE 'CVE-2024-' END, lpad(CAST(doc_id AS VARCHAR(20)), 6, '0'),
  '","descriptions":[{"lang":"', lang, '","value":"n', CAST(n_chars AS VARCHAR(20)), '"}],"metrics":{"',
  CASE doc_id % 3 WHEN 0 THEN 'cvssMetricV31' WHEN 1 THEN 'cvssMetricV30' ELSE 'cvssMetricV2' END,
  '":[{"cvssData":{"baseScore":', CAST(n_chars % 10 AS VARCHAR(20)), '}}]}}}') AS raw_json
FROM documents
"""

VIEWS["responses"] = """
SELECT flow_id AS response_id, concat('Assessment for Src IP: ', src_ip, CASE
   WHEN flow_id % 3 = 0 THEN concat('. curl -X POST http://ctl/stats/flowentry/add -d ''{"dpid": 1, "priority": 100, "match": {"ipv4_src": "', src_ip, '", "eth_type": 2048}, "actions": []}''')
   WHEN flow_id % 3 = 1 THEN '. curl -X POST http://ctl/stats/flowentry/add -d ''{"dpid": 1, "match": {"tcp_dst": 22}, "actions": ["OUTPUT"]}'''
   ELSE '. no command' END) AS output
FROM flows WHERE label <> 'Benign'
"""

VIEWS["search_blocks"] = """
SELECT page_id AS block_id, concat('Title: Vendor ', CAST(page_id % 40 AS VARCHAR(9)), concat(chr(10), 'URL: '), url, concat(chr(10), 'Description: d'), CAST(page_id AS VARCHAR(20)), chr(10)) AS block FROM pages
"""

VIEWS["packets"] = """
SELECT flow_id AS packet_id, ts, CAST(flow_id % 3 + 1 AS INT) AS dpid, src_ip AS src,
  replace(dst_ip, '10.1.', '10.0.') AS dst, CAST(flow_id % 4 + 1 AS INT) AS in_port
FROM flows
"""


# Views each view reads, so that a checking query can name only what it uses.
NEEDS = {
    "scores": ["votes"],
    "flow_stats": ["flows"],
    "responses": ["flows"],
    "packets": ["flows"],
}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views (and what they read) in front of it."""
    ordered: list[str] = []
    for name in names.split():
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    heads = [f"{name} AS ({VIEWS[name].strip()})" for name in ordered]
    text = body.strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(heads) + ",\n" + text[5:]
    return "WITH " + ",\n".join(heads) + "\n" + text
