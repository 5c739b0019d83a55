"""Structured Streaming jobs. Each has a batch twin with the same result on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtide.functions.timing import event_micros, window_micros
from flowtide.operators.live import append_rules, live_flows
from flowtide.operators.rules import rule_key
from flowtide.session import short_lived

#: State on disk, of which a batch writes its changes instead of the files it touches.
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_parts(spark: SparkSession) -> Iterator[None]:
    """Queries started inside cut their state into two parts for each core at most: every part is opened and committed
    with each batch, however few rows it has, and a stream keeps the number that it began with."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on disk, which list state and timers need."""
    before = {name: spark.conf.get(name, None) for name in _ROCKS}
    for name, value in _ROCKS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def poll_stream(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """Flow-statistics polls arriving as files of JSON lines."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(landing).withColumnRenamed("value", "raw_json")


def flow_stream(polls: DataFrame) -> DataFrame:
    """Polls to feature rows; stateless, so the batch code applies as it is."""
    return live_flows(polls)


def write_stream(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything available now to parquet, exactly once."""
    with rocks(df.sparkSession), state_parts(df.sparkSession):
        return (
            df.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .outputMode(mode)
            .trigger(availableNow=True)
            .start()
        )


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything available now to ``handle``, batch by batch."""
    with rocks(df.sparkSession), state_parts(df.sparkSession):
        return (
            df.writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def row_counts(*runs: StreamingQuery) -> dict[str, int]:
    """Rows read, emitted and late of all runs of one stream, and copies it left out, added up over their batches.

    ``trailing`` marks its late rows. ``unique_rules`` has the watermark drop them, which Spark counts row by row.
    ``rates`` counts after rows are added up, so there the rows of a stream that has ended are late if they are in
    no emitted window.
    """
    total: dict[str, int] = {}

    def add(name: str, value: int | None) -> None:
        total[name] = total.get(name, 0) + (value or 0)

    for progress in (p for run in runs for p in run.recentProgress):
        observed = {name: row.asDict() for name, row in progress.observedMetrics.items()}
        add("read", observed.get("read", {}).get("rows"))
        add("emitted", observed.get("emitted", {}).get("rows"))
        late = observed.get("emitted", {}).get("late")
        for operator in progress.stateOperators:
            if operator.operatorName == "dedupeWithinWatermark":
                late = (late or 0) + operator.numRowsDroppedByWatermark
                add("copies", operator.customMetrics.get("numDroppedDuplicateRows"))
        add("late", late)
    return total


def rates(df: DataFrame, key: str, window: str, delay: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Flows and bytes per key and event-time window; a window is final once the watermark
    passes its end, and rows later than that are dropped."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        df.observe("read", F.count(F.col(key)).alias("rows"))
        .withWatermark(ts, delay)
        .groupBy(span.alias("span"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n_flows"), F.sum("flow_bytes_s").alias("bytes_s"))
        .select(key, F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "n_flows", "bytes_s")
        .observe("emitted", F.sum(F.when(F.col(key).isNotNull(), F.col("n_flows"))).alias("rows"))
    )


def interval_pairs(
    rows: DataFrame, others: DataFrame, key: str, row_id: str, values: list[str], window: str, delay: str, ts: str = "ts"
) -> DataFrame:
    """Row id of each row of one stream with ``values`` of every row of another that has its key and a time in the window
    up to its own: the pairs of the trailing range join.

    Time is cut into buckets as wide as the window and the other side is there in its own and the next one, so a busy
    key is spread over its buckets. Either side is kept until the watermark says that nothing can match it any more.
    """
    width = window_micros(window)

    def bucket(df: DataFrame) -> Column:
        return F.floor(event_micros(df, ts) / width)

    left = rows.withWatermark(ts, delay).select(F.col(row_id), F.col(key).alias("__key"), F.col(ts).alias("__at"), bucket(rows).alias("__bucket"))
    right = others.withWatermark(ts, delay).select(
        F.col(key).alias("__other"), F.col(ts).alias("__then"), F.explode(F.array(bucket(others), bucket(others) + 1)).alias("__its"), *values)
    span = F.expr(f"INTERVAL {width} MICROSECONDS")
    met = (F.col("__key") == F.col("__other")) & (F.col("__bucket") == F.col("__its"))
    met &= (F.col("__then") > F.col("__at") - span) & (F.col("__then") <= F.col("__at"))
    return left.join(right, met).select(row_id, *values)


def unique_rules(rules: DataFrame, ts: str, horizon: str, salts: int = 16) -> DataFrame:
    """Rules not seen within the horizon, by rule key; state is forgotten behind the watermark.

    A rule that makes up much of the stream is spread over ``salts`` state keys, so up to that
    many copies pass; the store removes those while it writes.
    """
    keyed = rules.withColumns(
        {
            "rule_key": rule_key("command_type", "priority", "rule_json"),
            "salt": F.pmod(F.xxhash64(F.col(ts)), F.lit(salts)),
        }
    )
    counted = keyed.observe("read", F.count(F.lit(1)).alias("rows")).withWatermark(ts, horizon)
    return counted.dropDuplicatesWithinWatermark(["rule_key", "salt"]).observe("emitted", F.count(F.lit(1)).alias("rows"))


def store_rules(path: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that stores each rule once, also when a batch runs again."""

    def handle(rows: DataFrame, batch: int) -> None:
        append_rules(rows, path)

    return handle


def score_batches(score: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that scores rows and writes them under the batch id. What ``score`` writes aside is removed."""

    def handle(rows: DataFrame, batch: int) -> None:
        with short_lived():
            score(rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return handle
