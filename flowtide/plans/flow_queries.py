"""Named queries over flow records: scans, cleaning, trailing windows, sampling, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions.flow import port_category, protocol_category
from flowtide.functions.timing import event_micros, parse_timestamp
from flowtide.operators import cleaning, dictionaries, encoding, features, profile, rolling, sampling, segments
from flowtide.operators.rolling import Rolling
from flowtide.plans.registry import query
from flowtide.schemas import FLOW_COLUMNS, FLOW_SCHEMA
from flowtide.session import fresh_path
from flowtide.sources import adapters, files

DAY = "1day"
DAY_FRAME = "RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW"
SRC = f"(PARTITION BY src_ip ORDER BY ts {DAY_FRAME})"
DST = f"(PARTITION BY dst_ip ORDER BY ts {DAY_FRAME})"


def _six(name: str, out: str | None = None):
    return F.round(F.col(name), 6).alias(out or name)


# -- scans and sinks ---------------------------------------------------------------------


@query(
    "scan_flows",
    """SELECT src_ip, dst_ip, CAST(count(*) AS BIGINT) AS n_flows, round(sum(flow_bytes_s), 6) AS bytes_s
       FROM flows GROUP BY src_ip, dst_ip""",
    "flows",
)
def scan_flows(spark, folder):
    """Write the raw-layout CSV, scan it with the fixed schema, aggregate."""
    raw = adapters.flows(spark, folder).select(
        *[F.col(own).cast(FLOW_SCHEMA[raw].dataType).alias(raw) for raw, own in FLOW_COLUMNS.items()]
    )
    path = fresh_path(spark, "flows-csv")
    files.write_csv(raw, path)
    flows = files.normalise_flows(files.scan_flow_csv(spark, path))
    return flows.groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("n_flows"), F.round(F.sum("flow_bytes_s"), 6).alias("bytes_s")
    )


@query(
    "dataset_roundtrip",
    """SELECT is_test, label, CAST(count(*) AS BIGINT) AS n,
              round(sum(flow_duration), 6) AS duration
       FROM (SELECT *, substr(md5(concat('42:', CAST(flow_id AS VARCHAR))), 1, 15) < '333333333333333' AS is_test FROM flows)
       GROUP BY is_test, label""",
    "flows",
)
def dataset_roundtrip(spark, folder):
    flows = adapters.flows(spark, folder)
    base = fresh_path(spark, "datasets")
    train, test = sampling.train_test_split(flows, "flow_id")
    for name, part in {"train_original": train, "test_original": test}.items():
        files.save_dataset(part, base, name)
    train = files.load_dataset(spark, base, "train_original").withColumn("is_test", F.lit(False))
    test = files.load_dataset(spark, base, "test_original").withColumn("is_test", F.lit(True))
    return (
        train.unionByName(test)
        .groupBy("is_test", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flow_duration"), 6).alias("duration"))
    )


_PROFILED = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "label"]


@query(
    "dataset_profile",
    "\nUNION ALL\n".join(
        f"""SELECT CAST({i} AS INT) AS position, '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows,
            CAST(count(*) - count({c}) AS BIGINT) AS n_nulls,
            CAST(sum(strlen(CAST({c} AS VARCHAR))) AS BIGINT) AS text_bytes FROM flows"""
        for i, c in enumerate(_PROFILED)
    ),
    "flows",
)
def dataset_profile(spark, folder):
    return profile.dataset_profile(adapters.flows(spark, folder).select(*_PROFILED))


# -- columns and rows --------------------------------------------------------------------


@query(
    "keep_features",
    "SELECT flow_id, src_ip, dst_port, label FROM flows",
    "flows",
)
def keep_features(spark, folder):
    return cleaning.keep_selected_features(
        adapters.flows(spark, folder), ["dst_port", "src_ip", "flow_id", "no_such_column"], "label"
    )


@query("drop_features", "SELECT flow_id, src_ip, dst_ip, protocol, label FROM flows", "flows")
def drop_features(spark, folder):
    return cleaning.drop_irrelevant_features(
        adapters.flows(spark, folder), "ts, src_port,dst_port , flow_duration, flow_bytes_s, flow_packets_s"
    )


@query("align_schema", "SELECT protocol, flow_id, dst_ip, src_ip FROM flows", "flows")
def align_schema(spark, folder):
    return cleaning.align_schema(adapters.flows(spark, folder).drop("label"), ["protocol", "flow_id", "dst_ip", "src_ip"])


@query("malicious_only", "SELECT flow_id, label FROM flows WHERE label <> 'Benign'", "flows")
def malicious_only(spark, folder):
    return adapters.flows(spark, folder).where(F.col("label") != "Benign").select("flow_id", "label")


@query("binary_label", "SELECT flow_id, CAST(CASE WHEN label = 'Benign' THEN 0 ELSE 1 END AS INT) AS target FROM flows", "flows")
def binary_label(spark, folder):
    return adapters.flows(spark, folder).select(
        "flow_id", F.when(F.col("label") == "Benign", 0).otherwise(1).alias("target")
    )


_DIRTY = """SELECT flow_id, src_ip,
  CASE WHEN dst_port = 22 THEN CAST('Infinity' AS DOUBLE) WHEN dst_port = 53 THEN NULL
       WHEN dst_port = 25 THEN CAST('NaN' AS DOUBLE) WHEN dst_port = 21 THEN CAST('-Infinity' AS DOUBLE)
       ELSE flow_bytes_s END AS rate FROM flows"""


@query(
    "drop_incomplete",
    f"SELECT flow_id, src_ip, rate FROM ({_DIRTY}) WHERE rate IS NOT NULL AND isfinite(rate)",
    "flows",
)
def drop_incomplete(spark, folder):
    port = F.col("dst_port")
    dirty = adapters.flows(spark, folder).select(
        "flow_id",
        "src_ip",
        F.when(port == 22, F.lit(float("inf")))
        .when(port == 53, F.lit(None))
        .when(port == 25, F.lit(float("nan")))
        .when(port == 21, F.lit(float("-inf")))
        .otherwise(F.col("flow_bytes_s"))
        .alias("rate"),
    )
    return cleaning.drop_incomplete(dirty)


_CONSTANT_TEST = {"dst_ip": "dst_ip", "dst_port": "dst_port", "protocol": "protocol", "site": "'site-1'", "zone": "CAST(NULL AS VARCHAR)"}


@query(
    "constant_columns",
    """SELECT column_name FROM ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {e}) AS d FROM flows" for c, e in _CONSTANT_TEST.items())
    + ") WHERE d = 1",
    "flows",
)
def constant_columns(spark, folder):
    flows = adapters.flows(spark, folder).select(
        "dst_ip", "dst_port", "protocol", F.lit("site-1").alias("site"), F.lit(None).cast("string").alias("zone")
    )
    names = cleaning.constant_columns(flows)
    wide = flows.agg(*[F.max(c).alias(c) for c in names])
    return wide.select(F.explode(F.array(*[F.lit(c) for c in wide.columns])).alias("column_name"))


_RARE = "SELECT concat(label, '@', src_ip) AS class_name, flow_id FROM flows"


@query(
    "drop_rare_classes",
    f"SELECT class_name, flow_id FROM ({_RARE}) WHERE class_name IN "
    f"(SELECT class_name FROM ({_RARE}) GROUP BY class_name HAVING count(*) >= 15)",
    "flows",
)
def drop_rare_classes(spark, folder):
    classed = adapters.flows(spark, folder).select(F.concat_ws("@", "label", "src_ip").alias("class_name"), "flow_id")
    return cleaning.drop_rare_classes(classed, "class_name", 15)


_QUOTED = "CASE flow_id % 4 WHEN 0 THEN '''' || CAST(dst_port AS VARCHAR) WHEN 1 THEN CAST(dst_port AS VARCHAR) || ',5' WHEN 2 THEN 'x' ELSE CAST(dst_port AS VARCHAR) END"


@query(
    "clean_numeric",
    f"SELECT flow_id, TRY_CAST(replace(replace({_QUOTED}, ',', ''), '''', '') AS DOUBLE) AS amount FROM flows",
    "flows",
)
def clean_numeric(spark, folder):
    port, case = F.col("dst_port").cast("string"), F.col("flow_id") % 4
    quoted = adapters.flows(spark, folder).select(
        "flow_id",
        F.when(case == 0, F.concat(F.lit("'"), port))
        .when(case == 1, F.concat(port, F.lit(",5")))
        .when(case == 2, F.lit("x"))
        .otherwise(port)
        .alias("amount"),
    )
    return cleaning.clean_numeric(quoted, ["amount"])


@query(
    "dedupe_rows",
    "SELECT DISTINCT src_ip, dst_port, protocol, label FROM flows",
    "flows",
)
def dedupe_rows(spark, folder):
    return adapters.flows(spark, folder).select("src_ip", "dst_port", "protocol", "label").dropDuplicates()


@query(
    "clean_data",
    """WITH d AS (SELECT DISTINCT src_ip, dst_port, protocol, concat(label, '@', src_ip) AS label FROM flows)
       SELECT src_ip, dst_port, protocol, label FROM d
       WHERE label IN (SELECT label FROM d GROUP BY label HAVING count(*) >= 10)""",
    "flows",
)
def clean_data(spark, folder):
    flows = adapters.flows(spark, folder).select(
        "src_ip", "dst_port", "protocol", F.lit("site-1").alias("site"), F.concat_ws("@", "label", "src_ip").alias("label")
    )
    return cleaning.clean_data(flows, "label", 10)


@query("class_counts", "SELECT label, CAST(count(*) AS BIGINT) AS n FROM flows GROUP BY label", "flows")
def class_counts(spark, folder):
    return adapters.flows(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "column_cardinality",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM flows" for c in _PROFILED
    ),
    "flows",
)
def column_cardinality(spark, folder):
    return profile.column_cardinality(adapters.flows(spark, folder).select(*_PROFILED))


@query("unique_labels", "SELECT DISTINCT label FROM flows", "flows")
def unique_labels(spark, folder):
    return adapters.flows(spark, folder).select("label").distinct()


# -- scalars -----------------------------------------------------------------------------


@query(
    "port_category",
    """SELECT flow_id, CASE WHEN dst_port IN (80, 8080) THEN 'HTTP' WHEN dst_port = 443 THEN 'HTTPS'
         WHEN dst_port = 22 THEN 'SSH' WHEN dst_port = 53 THEN 'DNS' WHEN dst_port IN (25, 465, 587) THEN 'SMTP'
         WHEN dst_port = 21 THEN 'FTP' WHEN dst_port IN (3306, 5432) THEN 'DB'
         WHEN dst_port BETWEEN 0 AND 1023 THEN 'Well-Known' WHEN dst_port BETWEEN 49152 AND 65535 THEN 'Ephemeral'
         ELSE 'Other' END AS dst_category,
         CASE WHEN src_port IN (8080) THEN 'HTTP' WHEN src_port IN (3306, 5432) THEN 'DB'
         WHEN src_port BETWEEN 0 AND 1023 THEN 'Well-Known' WHEN src_port BETWEEN 49152 AND 65535 THEN 'Ephemeral'
         ELSE 'Other' END AS src_category FROM flows""",
    "flows",
)
def port_categories(spark, folder):
    return adapters.flows(spark, folder).select(
        "flow_id",
        port_category(F.col("dst_port")).alias("dst_category"),
        port_category(F.col("src_port")).alias("src_category"),
    )


@query(
    "protocol_category",
    "SELECT flow_id, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 0 THEN 'HOPOPT' END AS category FROM flows",
    "flows",
)
def protocol_categories(spark, folder):
    return adapters.flows(spark, folder).select("flow_id", protocol_category(F.col("protocol")).alias("category"))


_TS_TEXT = """CASE flow_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') ELSE strftime(ts, '%m/%d/%Y %I:%M:%S %p') END"""


@query(
    "parse_ts",
    f"""SELECT flow_id, CAST(epoch(CASE
          WHEN flow_id % 3 < 2 THEN date_trunc('second', ts)
          WHEN day(ts) <= 12 THEN make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), floor(second(ts)))
          ELSE date_trunc('second', ts) END) AS BIGINT) AS epoch_s FROM flows""",
    "flows",
)
def parse_ts(spark, folder):
    """Three layouts mixed; month-first text with a day up to 12 reads as day first."""
    case = F.col("flow_id") % 3
    text = (
        F.when(case == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(case == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .otherwise(F.date_format("ts", "MM/dd/yyyy hh:mm:ss a"))
    )
    parsed = adapters.flows(spark, folder).select("flow_id", parse_timestamp(text).alias("moment"))
    # Wall-clock seconds: the text carries no zone, so none may enter the reading.
    return parsed.select(
        "flow_id",
        (
            F.unix_date(F.to_date("moment")) * F.lit(86400).cast("long")
            + F.hour("moment") * 3600 + F.minute("moment") * 60 + F.second("moment")
        ).alias("epoch_s"),
    )


# -- trailing windows --------------------------------------------------------------------


def _rolling_query(name, key, kind, column, expression):
    sql_frame = SRC if key == "src_ip" else DST
    rounded = kind in ("sum", "mean", "entropy")
    sql_value = f"round({expression} OVER {sql_frame}, 6) + 0.0" if rounded else f"CAST({expression} OVER {sql_frame} AS BIGINT)"

    @query(name, f"SELECT flow_id, {sql_value} AS feature FROM flows", "flows")
    def run(spark, folder):
        out = rolling.rolling(adapters.flows(spark, folder), key, [Rolling("feature", kind, column)], DAY)
        return out.select("flow_id", _six("feature") if rounded else F.col("feature"))

    return run


_rolling_query("rolling_count", "src_ip", "count", "dst_port", "count(dst_port)")
_rolling_query("rolling_sum", "src_ip", "sum", "flow_bytes_s", "sum(flow_bytes_s)")
_rolling_query("rolling_count_dst", "dst_ip", "count", "src_port", "count(src_port)")
_rolling_query("rolling_sum_dst", "dst_ip", "sum", "flow_bytes_s", "sum(flow_bytes_s)")
_rolling_query("rolling_unique_dst_ports", "src_ip", "nunique", "dst_port", "count(DISTINCT dst_port)")
_rolling_query("rolling_unique_dst_ips", "src_ip", "nunique", "dst_ip", "count(DISTINCT dst_ip)")
_rolling_query("rolling_unique_src_ips", "dst_ip", "nunique", "src_ip", "count(DISTINCT src_ip)")
_rolling_query("rolling_unique_src_ports", "src_ip", "nunique", "src_port", "count(DISTINCT src_port)")
_rolling_query("rolling_entropy", "src_ip", "entropy", "dst_port", "entropy(dst_port)")
_rolling_query("rolling_avg", "src_ip", "mean", "flow_duration", "avg(flow_duration)")


@query(
    "range_self_join",
    f"""SELECT a.flow_id, CAST(count(b.dst_port) AS BIGINT) AS n_before, round(sum(b.flow_bytes_s), 6) AS bytes_before
        FROM flows a JOIN flows b ON a.src_ip = b.src_ip AND b.ts > a.ts - INTERVAL 1 DAY AND b.ts <= a.ts
        GROUP BY a.flow_id""",
    "flows",
)
def range_self_join(spark, folder):
    """The per-key range self-join and aggregate, without forming its pairs."""
    wanted = [Rolling("n_before", "count", "dst_port"), Rolling("bytes_before", "sum", "flow_bytes_s")]
    out = rolling.rolling(adapters.flows(spark, folder), "src_ip", wanted, DAY)
    return out.select("flow_id", "n_before", _six("bytes_before"))


@query(
    "rolling_halo",
    f"""SELECT flow_id, CAST(count(dst_port) OVER w AS BIGINT) AS n, round(max(flow_packets_s) OVER w, 6) AS peak,
               round(min(flow_packets_s) OVER w, 6) AS low FROM flows WINDOW w AS {SRC}""",
    "flows",
)
def rolling_halo(spark, folder):
    """Any built-in aggregate over the frame, per (key, time bucket) with a halo bucket."""
    out = rolling.rolling_framed(
        adapters.flows(spark, folder),
        "src_ip",
        {"n": F.count("dst_port"), "peak": F.max("flow_packets_s"), "low": F.min("flow_packets_s")},
        DAY,
    )
    return out.select("flow_id", "n", _six("peak"), _six("low"))


_ENGINEERED_SQL = f"""SELECT flow_id,
  CAST(count(dst_port) OVER s AS BIGINT) AS "Flows_per_SrcIP_1d",
  round(sum(flow_bytes_s) OVER s, 6) AS "Bytes_per_SrcIP_1d",
  CAST(count(DISTINCT dst_port) OVER s AS BIGINT) AS "Unique_DstPorts_per_SrcIP_1d",
  CAST(count(DISTINCT dst_ip) OVER s AS BIGINT) AS "Unique_DstIPs_per_SrcIP_1d",
  CAST(count(DISTINCT src_port) OVER s AS BIGINT) AS "Unique_SrcPorts_per_SrcIP_1d",
  round(entropy(dst_port) OVER s, 6) + 0.0 AS "Entropy_DstPorts_per_SrcIP_1d",
  round(avg(flow_duration) OVER s, 6) AS "Avg_FlowDuration_per_SrcIP_1d",
  CAST(count(src_port) OVER d AS BIGINT) AS "Flows_per_DstIP_1d",
  round(sum(flow_bytes_s) OVER d, 6) AS "Bytes_per_DstIP_1d",
  CAST(count(DISTINCT src_ip) OVER d AS BIGINT) AS "Unique_SrcIPs_per_DstIP_1d",
  CASE WHEN dst_port IN (80, 8080) THEN 'HTTP' WHEN dst_port = 443 THEN 'HTTPS' WHEN dst_port = 22 THEN 'SSH'
    WHEN dst_port = 53 THEN 'DNS' WHEN dst_port IN (25, 465, 587) THEN 'SMTP' WHEN dst_port = 21 THEN 'FTP'
    WHEN dst_port IN (3306, 5432) THEN 'DB' WHEN dst_port BETWEEN 0 AND 1023 THEN 'Well-Known'
    WHEN dst_port BETWEEN 49152 AND 65535 THEN 'Ephemeral' ELSE 'Other' END AS "DstPortCategory",
  CASE WHEN src_port IN (8080) THEN 'HTTP' WHEN src_port IN (3306, 5432) THEN 'DB'
    WHEN src_port BETWEEN 0 AND 1023 THEN 'Well-Known' WHEN src_port BETWEEN 49152 AND 65535 THEN 'Ephemeral'
    ELSE 'Other' END AS "SrcPortCategory",
  CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 0 THEN 'HOPOPT' END AS "ProtocolCategory"
  FROM flows WINDOW s AS {SRC}, d AS {DST}"""

_ROUNDED = [
    "Bytes_per_SrcIP_1d",
    "Entropy_DstPorts_per_SrcIP_1d",
    "Avg_FlowDuration_per_SrcIP_1d",
    "Bytes_per_DstIP_1d",
]


@query("engineer_features", _ENGINEERED_SQL, "flows")
def engineer_features(spark, folder):
    out = features.engineer_features(adapters.flows(spark, folder), DAY, "1d")
    kept = [c for c in out.columns if c == "flow_id" or c.endswith("_1d") or c.endswith("Category")]
    return out.select(*[_six(c) if c in _ROUNDED else F.col(c) for c in kept])


@query(
    "inference_features",
    f"""WITH f AS ({_ENGINEERED_SQL}),
        stats AS (SELECT avg("Flows_per_SrcIP_1d") AS m, stddev_pop("Flows_per_SrcIP_1d") AS s FROM f)
        SELECT flow_id, round(("Flows_per_SrcIP_1d" - m) / s, 6) AS "Flows_per_SrcIP_1d",
          CASE WHEN "ProtocolCategory" = 'HOPOPT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "ProtocolCategory_HOPOPT",
          CASE WHEN "ProtocolCategory" = 'TCP' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "ProtocolCategory_TCP",
          CASE WHEN "ProtocolCategory" = 'UDP' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "ProtocolCategory_UDP"
        FROM f, stats""",
    "flows",
)
def inference_features(spark, folder):
    """Numeric clean, features, column contract, fitted encoder."""
    raw = cleaning.clean_numeric(adapters.flows(spark, folder), ["flow_bytes_s", "flow_packets_s", "flow_duration"])
    wanted = ["flow_id", "Flows_per_SrcIP_1d", "ProtocolCategory"]
    # Only the aligned features are asked for, so only one key's timeline is built.
    featured = rolling.rolling(raw, "src_ip", [Rolling("Flows_per_SrcIP_1d", "count", "dst_port")], DAY)
    aligned = cleaning.align_schema(features.add_categories(featured), wanted)
    encoder = encoding.FlowEncoder.fit(aligned, ["Flows_per_SrcIP_1d"], ["ProtocolCategory"])
    out = encoder.transform(aligned)
    return out.withColumn("Flows_per_SrcIP_1d", F.round("Flows_per_SrcIP_1d", 6))


@query(
    "row_ids",
    "SELECT flow_id, CAST(row_number() OVER (PARTITION BY src_ip ORDER BY ts, flow_id) AS BIGINT) AS idx FROM flows",
    "flows",
)
def row_ids(spark, folder):
    flows = adapters.flows(spark, folder)
    keyed = flows.select("flow_id", "src_ip", event_micros(flows, "ts").alias("us"))
    cut = segments.even_cuts(keyed, "us", "flow_id")
    numbered = segments.ranked(cut, ["src_ip"], F.col("__cut"), [F.col("us"), F.col("flow_id")], out="idx")
    return numbered.select("flow_id", "idx")


# -- sampling ----------------------------------------------------------------------------

_DIGEST = "md5(concat('42:', CAST(flow_id AS VARCHAR)))"


@query("hash_sample", f"SELECT flow_id FROM flows WHERE substr({_DIGEST}, 1, 15) < '0cccccccccccccc'", "flows")
def hash_sample(spark, folder):
    return sampling.hash_sample(adapters.flows(spark, folder), "flow_id", 0.05).select("flow_id")


@query("sample_n", f"SELECT flow_id FROM flows ORDER BY {_DIGEST}, flow_id LIMIT 20", "flows")
def sample_n(spark, folder):
    return sampling.exact_sample(adapters.flows(spark, folder).select("flow_id"), "flow_id", n=20)


@query(
    "sample_fraction_exact",
    f"SELECT flow_id FROM (SELECT flow_id, row_number() OVER (ORDER BY {_DIGEST}, flow_id) AS rn, count(*) OVER () AS n FROM flows) "
    "WHERE rn <= round_even(n * 0.05, 0)",
    "flows",
)
def sample_fraction_exact(spark, folder):
    return sampling.exact_sample(adapters.flows(spark, folder).select("flow_id"), "flow_id", fraction=0.05)


@query(
    "train_test_split",
    f"SELECT flow_id, substr({_DIGEST}, 1, 15) < '333333333333333' AS is_test FROM flows",
    "flows",
)
def train_test_split(spark, folder):
    return sampling.with_split(adapters.flows(spark, folder).select("flow_id"), "flow_id", 0.2)


@query(
    "stratified_folds",
    f"""SELECT flow_id, CAST((row_number() OVER (PARTITION BY label ORDER BY {_DIGEST}, flow_id) - 1) % 5 AS INT) AS fold
        FROM flows""",
    "flows",
)
def stratified_folds(spark, folder):
    return sampling.stratified_folds(adapters.flows(spark, folder).select("flow_id", "label"), "label", "flow_id").select(
        "flow_id", "fold"
    )


# -- encoding ----------------------------------------------------------------------------

_SCALED = ["flow_duration", "flow_bytes_s", "dst_port"]


@query(
    "scaler_stats",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM flows" for c in _SCALED
    ),
    "flows",
)
def scaler_stats(spark, folder):
    stats = encoding.scaler_stats(adapters.flows(spark, folder), _SCALED)
    return stats.select("column_name", _six("mean"), _six("std"))


@query(
    "standard_scale",
    """SELECT flow_id, round((flow_duration - m1) / s1, 6) AS flow_duration, round((dst_port - m2) / s2, 6) AS dst_port
       FROM flows, (SELECT avg(flow_duration) AS m1, stddev_pop(flow_duration) AS s1, avg(dst_port) AS m2,
                    stddev_pop(dst_port) AS s2 FROM flows)""",
    "flows",
)
def standard_scale(spark, folder):
    flows = adapters.flows(spark, folder).select("flow_id", "flow_duration", "dst_port")
    scaled = encoding.FlowEncoder.fit(flows, ["flow_duration", "dst_port"], []).transform(flows)
    return scaled.select("flow_id", _six("flow_duration"), _six("dst_port"))


@query(
    "one_hot",
    "SELECT flow_id, "
    + ", ".join(
        f"CASE WHEN label = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"label_{v}\""
        for v in ["Benign", "DNS Flood", "Dictionary Attack", "ICMP Flood", "Port Scan"]
    )
    + " FROM flows",
    "flows",
)
def one_hot(spark, folder):
    flows = adapters.flows(spark, folder).select("flow_id", "label")
    return encoding.FlowEncoder.fit(flows, [], ["label"]).transform(flows)


@query(
    "label_encode",
    """SELECT flow_id, CAST(d.code AS INT) AS label_code, f.label AS decoded FROM flows f JOIN
       (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM flows)) d
       ON f.label = d.label""",
    "flows",
)
def label_encode(spark, folder):
    flows = adapters.flows(spark, folder).select("flow_id", "label")
    codes = encoding.LabelCodes.fit(flows, "label")
    return codes.decode(codes.encode(flows, "label"), "label_code", "decoded").drop("label")


@query(
    "dictionary_codes",
    """SELECT flow_id, s.code AS src_code, d.code AS dst_code, f.src_ip AS src_back FROM flows f
       JOIN (SELECT src_ip, dense_rank() OVER (ORDER BY src_ip) - 1 AS code FROM (SELECT DISTINCT src_ip FROM flows)) s ON f.src_ip = s.src_ip
       JOIN (SELECT dst_ip, dense_rank() OVER (ORDER BY dst_ip) - 1 AS code FROM (SELECT DISTINCT dst_ip FROM flows)) d ON f.dst_ip = d.dst_ip""",
    "flows",
)
def dictionary_codes(spark, folder):
    """Addresses to codes through a dictionary of any size, and back."""
    flows = adapters.flows(spark, folder).select("flow_id", "src_ip", "dst_ip")
    known = dictionaries.Dictionary.fit(flows, ["src_ip", "dst_ip"])
    coded = known.encode(known.encode(flows, "src_ip", "src_code", "fail"), "dst_ip", "dst_code", "fail")
    return known.decode(coded, "src_code", "src_ip", "src_back").drop("src_ip", "dst_ip")


@query(
    "sparse_features",
    """WITH s AS (SELECT src_ip, dense_rank() OVER (ORDER BY src_ip) - 1 AS code FROM (SELECT DISTINCT src_ip FROM flows)),
        d AS (SELECT dst_ip, dense_rank() OVER (ORDER BY dst_ip) - 1 AS code FROM (SELECT DISTINCT dst_ip FROM flows)),
        n AS (SELECT count(DISTINCT src_ip) AS src, count(DISTINCT dst_ip) AS dst, avg(flow_duration) AS m, stddev_pop(flow_duration) AS sd FROM flows)
        SELECT flow_id, CAST(src + dst + 1 AS INT) AS width, CAST(s.code AS INT) AS src_place, CAST(src + d.code AS INT) AS dst_place,
          round((flow_duration - m) / sd, 6) AS scaled
        FROM flows f JOIN s ON f.src_ip = s.src_ip JOIN d ON f.dst_ip = d.dst_ip, n""",
    "flows",
)
def sparse_features(spark, folder):
    """One sparse vector a flow, addresses one-hot: its width, the places that are set and the number behind them."""
    flows = adapters.flows(spark, folder).select("flow_id", "src_ip", "dst_ip", "flow_duration")
    made = dictionaries.SparseEncoder.fit(flows, ["flow_duration"], ["src_ip", "dst_ip"]).transform(flows)
    # the sparse parts as they are stored; a scaled number of exactly 0 is not stored
    vector = F.from_json(F.to_json(F.struct("features")), "features struct<size int, indices array<int>, values array<double>>").getField("features")
    return made.select("flow_id", vector.alias("v")).select(
        "flow_id", F.col("v.size").alias("width"), F.get("v.indices", F.lit(0)).alias("src_place"), F.get("v.indices", F.lit(1)).alias("dst_place"),
        F.round(F.coalesce(F.get("v.values", F.lit(2)), F.lit(0.0)), 6).alias("scaled"))


@query(
    "transform_data",
    f"""WITH f AS (SELECT flow_id, label, flow_duration, substr({_DIGEST}, 1, 15) < '333333333333333' AS is_test FROM flows),
        p AS (SELECT avg(flow_duration) AS m, stddev_pop(flow_duration) AS s FROM f WHERE NOT is_test),
        q AS (SELECT avg(flow_duration) AS m, stddev_pop(flow_duration) AS s FROM f WHERE NOT is_test AND label <> 'Benign'),
        c AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM f WHERE label <> 'Benign' AND NOT is_test))
        SELECT 'pre_detection' AS stage, is_test, flow_id, round((flow_duration - m) / s, 6) AS flow_duration,
          CAST(CASE WHEN label = 'Benign' THEN 0 ELSE 1 END AS INT) AS target FROM f, p
        UNION ALL
        SELECT 'post_classification', is_test, flow_id, round((flow_duration - m) / s, 6), CAST(code AS INT)
        FROM f JOIN c ON f.label = c.label, q""",
    "flows",
)
def transform_data(spark, folder):
    """Two separately fitted encoders: all rows for detection, malicious rows for classification."""
    from flowtide.plans.training import transform_data as split_and_encode

    flows = adapters.flows(spark, folder).select("flow_id", "label", "flow_duration")
    prepared = split_and_encode(flows, "label", "flow_id", numeric=["flow_duration"], categorical=[])
    return prepared.encoded().select("stage", "is_test", "flow_id", _six("flow_duration"), "target")
