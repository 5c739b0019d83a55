"""Named queries that run a stream over the given tables to its end and read its output."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions.timing import event_micros
from flowtide.operators import rules
from flowtide.operators.rolling import Rolling
from flowtide.plans.flow_queries import DAY, SRC
from flowtide.plans.network_queries import _ENTRY_SQL, _RULE_SQL, _polls
from flowtide.plans.registry import query
from flowtide.session import fresh_path
from flowtide.sources import adapters
from flowtide.streaming import streams
from flowtide.streaming.trailing import trailing


def _run_landed(spark, folder, start, parts=3, closing=None):
    """Run ``start(stream of flows)`` to its end once for each of equal spans of time, landed in order.

    A trigger takes all files of a span, so it does not matter how many there are and in which order
    they were written; the checkpoint carries the state from span to span. ``closing`` is the distance behind
    the last flow of a last row without anything but a time, which ends the stream. Returns the last run.
    """
    flows = adapters.flows(spark, folder)
    landing = fresh_path(spark, "flows-landing")
    us = event_micros(flows, "ts")
    ends = flows.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    span = (ends["hi"] - ends["lo"]) // parts + 1
    for i in range(parts):
        part = flows.where(F.floor((us - F.lit(ends["lo"])) / span) == i)
        part.write.mode("append").parquet(landing)
        run = start(spark.readStream.schema(flows.schema).parquet(landing))
        run.awaitTermination()
    if closing:
        nothing = [F.max(F.lit(None).cast(f.dataType)).alias(f.name) for f in flows.schema if f.name != "ts"]
        last = flows.agg((F.max("ts") + F.expr(f"INTERVAL {closing}")).alias("ts"), *nothing).select(flows.columns)
        last.where(F.col("ts").isNotNull()).write.mode("append").parquet(landing)
        run = start(spark.readStream.schema(flows.schema).parquet(landing))
        run.awaitTermination()
    return run


def _utc(flows):
    """Wall-clock times as instants in UTC, whatever the session zone."""
    return flows.withColumn("ts", F.timestamp_micros(event_micros(flows, "ts")))


@query(
    "stream_flows",
    f"""SELECT flow_id % 3 + 1 AS dpid, coalesce(s4, sn) AS src_ip, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN secs > 0 THEN bytes / secs ELSE 0 END), 4) AS bytes_s
        FROM ({_ENTRY_SQL}) WHERE s4 IS NOT NULL OR sn IS NOT NULL GROUP BY 1, 2""",
    "flow_stats",
)
def stream_flows(spark, folder):
    landing, out = fresh_path(spark, "polls-landing"), fresh_path(spark, "live-flows")
    _polls(spark, folder).select("raw_json").write.text(landing)
    flows = streams.flow_stream(streams.poll_stream(spark, landing))
    streams.write_stream(flows, out, fresh_path(spark, "stream-flows-log")).awaitTermination()
    return (
        spark.read.schema(flows.schema)
        .parquet(out)
        .groupBy("dpid", "src_ip")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flow_bytes_s"), 4).alias("bytes_s"))
    )


@query(
    "stream_rolling",
    f"""SELECT flow_id, CAST(count(dst_port) OVER w AS BIGINT) AS n, CAST(count(DISTINCT dst_port) OVER w AS BIGINT) AS ports,
         round(sum(flow_bytes_s) OVER w, 6) AS bytes FROM flows WINDOW w AS {SRC}""",
    "flows",
)
def stream_rolling(spark, folder):
    """Trailing features of every row; a row that ends the stream makes the last ones final."""
    features = [Rolling("n", "count", "dst_port"), Rolling("ports", "nunique", "dst_port"), Rolling("bytes", "sum", "flow_bytes_s")]
    out, log = fresh_path(spark, "trailing"), fresh_path(spark, "trailing-log")

    def start(flows):
        return streams.write_stream(trailing(_utc(flows), "src_ip", "flow_id", features, DAY, "1 hour", slices=2), out, log)

    _run_landed(spark, folder, start, closing="3 DAYS")
    return spark.read.parquet(out).select("flow_id", "n", "ports", F.round("bytes", 6).alias("bytes"))


@query(
    "stream_range_join",
    """SELECT a.flow_id, CAST(count(b.dst_port) AS BIGINT) AS n_before, round(sum(b.flow_bytes_s), 6) AS bytes_before
       FROM flows a JOIN flows b ON a.src_ip = b.src_ip AND b.ts > a.ts - INTERVAL 1 HOUR AND b.ts <= a.ts GROUP BY a.flow_id""",
    "flows",
)
def stream_range_join(spark, folder):
    """The per-key range self-join as a join of two streams, for the flows of the last hour of each."""
    out, log = fresh_path(spark, "range-pairs"), fresh_path(spark, "range-pairs-log")

    def start(flows):
        pairs = streams.interval_pairs(_utc(flows), _utc(flows), "src_ip", "flow_id", ["dst_port", "flow_bytes_s"], "1 hour", "10 minutes")
        return streams.write_stream(pairs, out, log)

    _run_landed(spark, folder, start)
    pairs = spark.read.parquet(out)
    return pairs.groupBy("flow_id").agg(F.count("dst_port").alias("n_before"), F.round(F.sum("flow_bytes_s"), 6).alias("bytes_before"))


@query(
    "stream_rates",
    """SELECT src_ip, CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_us, CAST(count(*) AS BIGINT) AS n_flows, round(sum(flow_bytes_s), 6) AS bytes_s
       FROM flows GROUP BY src_ip, time_bucket(INTERVAL 1 HOUR, ts)
       HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM flows)""",
    "flows",
)
def stream_rates(spark, folder):
    """Hourly rates of the windows that are final when the stream ends."""
    out, log = fresh_path(spark, "rates"), fresh_path(spark, "rates-log")

    def start(flows):
        return streams.write_stream(streams.rates(_utc(flows), "src_ip", "1 hour", "10 minutes"), out, log)

    _run_landed(spark, folder, start)
    stored = spark.read.parquet(out)
    return stored.select(
        "src_ip", F.unix_micros("window_start").alias("window_us"), "n_flows", F.round("bytes_s", 6).alias("bytes_s")
    )


@query(
    "stream_rules",
    f"SELECT command_type, priority, rule_json, CAST(1 AS BIGINT) AS times_stored FROM ({_RULE_SQL}) WHERE label <> 'Benign' GROUP BY 1, 2, 3",
    "flows",
)
def stream_rules(spark, folder):
    """Rules from streamed predictions, stateful duplicate removal, idempotent storage."""
    path, log = fresh_path(spark, "stream-rules"), fresh_path(spark, "stream-rules-log")

    def start(flows):
        made = rules.rules_from_predictions(_utc(flows), ["ts"], "label", dpid=2)
        return streams.each_batch(streams.unique_rules(made, "ts", "1 hour"), streams.store_rules(path), log)

    _run_landed(spark, folder, start)
    stored = spark.read.parquet(path)
    return stored.groupBy("command_type", "priority", "rule_json").agg(F.count(F.lit(1)).alias("times_stored"))
