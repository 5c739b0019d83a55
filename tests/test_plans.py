"""What the plans must and must not contain."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from flowtide.operators.rolling import rolling_framed
from flowtide.sources import adapters

NATIVE = sorted(
    set(entry.oracle_sql())
    - {"knn_join", "knn_join_manhattan", "knn_join_chebyshev", "cosine_topk", "knn_classify", "resolve_ties"}
    - {n for n in entry.oracle_sql() if n.startswith("stream_") or re.match(r"op\d+_|pipeline", n)}
)
HEAVY = {"knowledge_append", "rule_sink", "scan_flows", "dataset_roundtrip", "report_rows", "flow_stats_explode"}


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", [n for n in NATIVE if n not in HEAVY])
def test_no_python_no_cross_join(spark, small, name):
    text = plan(entry.queries()[name](spark, small))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["row_ids", "asof_forwarding", "linear_links", "topology_graph", "host_ports", "pr_curve"])
def test_no_window_in_one_task(spark, small, name):
    assert "SinglePartition" not in plan(entry.queries()[name](spark, small))


def test_scan_reads_only_what_is_asked(spark, small):
    text = plan(entry.queries()["rolling_count"](spark, small))
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert reads and all("value" not in r for r in reads)
    filtered = plan(entry.queries()["malicious_only"](spark, small))
    assert "event_type" in re.search(r"ReadSchema: struct<([^>]*)>", filtered)[1]
    assert "props" not in re.search(r"ReadSchema: struct<([^>]*)>", filtered)[1]


@pytest.mark.parametrize("name", ["hard_vote", "train_test_split", "hash_sample", "parse_responses", "rules_from_predictions", "flow_normalize", "one_hot", "label_encode", "chunk_text", "mention_context"])
def test_row_local_operators_do_not_shuffle(spark, small, name):
    assert "Exchange" not in plan(entry.queries()[name](spark, small))


def test_framed_window_shuffles_once(spark, small):
    from pyspark.sql import functions as F

    df = rolling_framed(adapters.flows(spark, small), "src_ip", {"n": F.count("dst_port"), "p": F.max("flow_packets_s")}, "1s")
    text = plan(df)
    assert len(re.findall(r"\(\d+\) Exchange\n", text)) == 1


def test_key_windows_are_cut_by_time(spark, small):
    text = plan(entry.queries()["rolling_count"](spark, small))
    for arguments in re.findall(r"\(\d+\) Exchange\nInput.*\nArguments: hashpartitioning\((.*)\)", text):
        assert "__us" in arguments or "__bucket" in arguments, arguments
