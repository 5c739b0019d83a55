"""Streams give the rows of their batch twins, whatever files the rows arrive in."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import connect, difference
from flowtide.operators.live import append_rules
from flowtide.operators.rolling import Rolling, rolling
from flowtide.streaming import streams
from flowtide.streaming.trailing import trailing

FEATURES = [
    Rolling("n", "count", "port"), Rolling("u", "nunique", "port"), Rolling("s", "sum", "port"), Rolling("m", "mean", "port"),
    Rolling("e", "entropy", "ip"), Rolling("v", "nunique", "ip"),
]
NAMES = [f.name for f in FEATURES]
LAID = "row_id long, key string, t long, port int, ip string"


def run_trailing(spark, tmp_path, batches, window="45s", delay="60 seconds", slices=8):
    """Land the batches one by one, then the row that ends the stream; the output and the runs."""
    source, schema, runs = str(tmp_path / "in"), "row_id long, key string, ts timestamp, port int, ip string", []
    last = max(t for batch in batches for _, _, t, *_ in batch if t is not None)
    for batch in [*batches, [(None, None, last + 100_000, None, None)]]:
        rows = spark.createDataFrame(batch, LAID)
        rows.withColumn("ts", F.timestamp_seconds("t")).select("row_id", "key", "ts", "port", "ip").repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        runs.append(streams.write_stream(trailing(stream, "key", "row_id", FEATURES, window, delay, slices=slices), str(tmp_path / "out"), str(tmp_path / "log")))
        runs[-1].awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")), runs


def rows_of(df):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    found = [(r["row_id"], tuple(plain(r[n]) for n in NAMES)) for r in df.collect()]
    assert len(dict(found)) == len(found)
    return dict(found)


def twin(spark, rows, window):
    return rows_of(rolling(spark.createDataFrame(rows, LAID).withColumn("ts", F.timestamp_seconds("t")), "key", FEATURES, window))


@pytest.mark.parametrize("slices", [1, 9])
def test_trailing_features_by_batches(spark, tmp_path, slices):
    rows = [(i, f"k{i % 3}" if i % 11 else None, 1000 + 10 * i + (i % 4), i % 5 if i % 7 else None, f"10.0.0.{i % 6}" if i % 13 else None) for i in range(60)]
    batches = [rows[0:20], rows[22:40], rows[20:22] + rows[40:60]]  # two rows come one batch late
    got, runs = run_trailing(spark, tmp_path, batches, delay="300 seconds", slices=slices)
    assert rows_of(got.where("not late")) == twin(spark, rows, "45s") and got.where("late").count() == 0
    assert streams.row_counts(*runs) == {"read": 60, "emitted": 60, "late": 0}


def test_a_key_with_most_of_the_rows(spark, tmp_path):
    rows = [(i, "hot" if i % 10 else f"k{i % 7}", 5000 + i // 3, i * 37 % 101, f"10.0.{i % 5}.{i % 17}") for i in range(1500)]
    got, runs = run_trailing(spark, tmp_path, [rows[i::4] for i in range(4)], "120s", "600 seconds", slices=12)
    assert rows_of(got) == twin(spark, rows, "120s")
    assert streams.row_counts(*runs) == {"read": 1500, "emitted": 1500, "late": 0}


def test_late_rows_are_marked_and_count_nowhere(spark, tmp_path):
    first = [(1, "k", 1000, 1, "a"), (2, "k", 1030, 2, "b"), (3, "j", 2000, 1, "a")]
    second = [(4, "k", 1020, 7, "c"), (5, "j", 1990, 3, "b"), (6, None, 1000, 1, "a")]  # 4 is far behind, 5 is not
    got, runs = run_trailing(spark, tmp_path, [first, [(7, "x", 2000, 1, "a")], second], "60s", "20 seconds", slices=6)
    assert [r["row_id"] for r in got.where("late").collect()] == [4]
    on_time = [r for r in [*first, (7, "x", 2000, 1, "a"), *second] if r[0] != 4]
    assert rows_of(got.where("not late")) == twin(spark, on_time, "60s")
    assert streams.row_counts(*runs) == {"read": 7, "emitted": 7, "late": 1}


def test_rates_and_rules_count_late_rows(spark, tmp_path):
    source, runs = str(tmp_path / "in"), []
    kind = "key string, ts timestamp, flow_bytes_s double"
    for batch in ([("a", 100), ("a", 130), ("b", 5000)], [("b", 5100)], [("a", 110), ("b", 5050)], [(None, 100_000)]):
        spark.createDataFrame(batch, "key string, t long").select("key", F.timestamp_seconds("t").alias("ts"), F.lit(1.0).alias("flow_bytes_s")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        runs.append(streams.write_stream(streams.rates(stream, "key", "1 minute", "30 seconds"), str(tmp_path / "out"), str(tmp_path / "log")))
        runs[-1].awaitTermination()
    counts = streams.row_counts(*runs)
    assert (counts["read"], counts["emitted"]) == (6, 5)  # a's row at 110 came after its window had been emitted

    source, runs = str(tmp_path / "rules"), []
    kind = "command_type string, priority int, rule_json string, ts timestamp"
    for batch in ([("{1}", 100), ("{1}", 100), ("{2}", 5000)], [("{2}", 5001)], [("{3}", 100), ("{4}", 5002)]):
        rows = spark.createDataFrame(batch, "rule_json string, t long")
        rows.select(F.lit("block").alias("command_type"), F.lit(1).alias("priority"), "rule_json", F.timestamp_seconds("t").alias("ts")).write.mode("append").parquet(source)
        made = spark.readStream.schema(kind).parquet(source)
        runs.append(streams.write_stream(streams.unique_rules(made, "ts", "60 seconds", salts=1), str(tmp_path / "kept"), str(tmp_path / "rules-log")))
        runs[-1].awaitTermination()
    counts = streams.row_counts(*runs)
    assert counts == {"read": 6, "emitted": 3, "late": 1, "copies": 2}
    assert counts["read"] == counts["emitted"] + counts["late"] + counts["copies"]


@pytest.mark.parametrize("name", ["stream_rates", "stream_rules", "stream_rolling", "stream_range_join"])
def test_many_files_give_the_same_rows(spark, small, tmp_path, name):
    """The table as nine files in no order of time."""
    spark.read.parquet(f"{small}/events.parquet").orderBy(F.xxhash64("event_id")).repartition(9).write.parquet(str(tmp_path / "events.parquet"))
    mine = entry.queries()[name](spark, str(tmp_path)).toPandas()
    assert difference(mine, connect(small).execute(entry.oracle_sql()[name]).df()) is None


def test_rules_are_stored_once(spark, tmp_path):
    columns = "command_type string, description string, rule_json string, priority int, dpid int, src_ip string"
    made = spark.createDataFrame([("block_host", "d", "{1}", 100, 1, "a")] * 3 + [("block_host", "d", "{2}", 100, 1, "b")], columns)
    for _ in range(3):
        append_rules(made, str(tmp_path / "rules"))
    assert spark.read.parquet(str(tmp_path / "rules")).count() == 2
