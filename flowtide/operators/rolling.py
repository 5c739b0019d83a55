"""Trailing time-window features per key.

The frame is left-open and right-closed, ``(t - w, t]``, so rows with equal times all see
each other. Cost is linear in the rows however many share a frame, and no group of rows is
ever collected:

1. rows are pre-aggregated per (key, time) and, for value features, per (key, value, time);
   a flood that shares one clock tick shrinks map-side before any shuffle;
2. time is cut into buckets as wide as the window. A frame then is a prefix of its own
   bucket plus a suffix of the bucket before. Each pre-aggregated row is sent to its own
   bucket and, moved by ``w``, to the next one: there it counts while its moved position is
   later than the reading row. Both parts are running sums over (key, bucket);
3. distinct counts and entropy follow the number of copies of each value the same way and
   emit only the change at each position;
4. the readings, one per (key, time), are joined back to the rows.

A hot key is spread over its buckets, and one (key, bucket) holds at most ``2 w`` positions
(two million at the default one second), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.functions.timing import event_micros, window_micros

KINDS = ("count", "sum", "mean", "nunique", "entropy")


@dataclass(frozen=True)
class Rolling:
    """One feature: ``kind`` of ``column`` written to ``name``."""

    name: str
    kind: str
    column: str

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown rolling aggregate {self.kind!r}")


def _spread(rows: DataFrame, window: int, own: Column, moved: Column) -> DataFrame:
    """Each row once in its own bucket and once, moved by the window, in the next."""
    return rows.select("*", F.inline_outer(F.array(own, moved))).withColumn(
        "__bucket", F.col("__pos") - F.pmod(F.col("__pos"), F.lit(window))
    )


def _copies_cost(copies: Column) -> Column:
    """``c * log2(c)``, zero for no copies."""
    return F.when(copies > 0, copies * F.log2(copies)).otherwise(F.lit(0.0))


def _value_changes(facts: DataFrame, key: str, columns: Sequence[str], window: int) -> DataFrame:
    """Changes of (distinct values, sum of c*log2 c) per value column along each bucket."""
    tagged = F.array(
        *[F.struct(F.lit(i).alias("__which"), F.col(c).cast("string").alias("__value")) for i, c in enumerate(columns)]
    )
    seen = (
        facts.select(key, "__us", F.inline_outer(tagged))
        .where(F.col("__value").isNotNull())
        .groupBy(key, "__which", "__value", "__us")
        .agg(F.count(F.lit(1)).alias("__copies"))
    )
    # Own and moved copies that meet at one position need no merging here: their changes are
    # summed per position afterwards.
    moves = _spread(
        seen,
        window,
        F.struct(F.col("__us").alias("__pos"), F.col("__copies").alias("__step"), F.lit(0).cast("long").alias("__held")),
        F.struct(
            (F.col("__us") + window).alias("__pos"), (-F.col("__copies")).alias("__step"), F.col("__copies").alias("__held")
        ),
    )
    along = Window.partitionBy(key, "__bucket", "__which", "__value").orderBy("__pos")
    counted = moves.select(
        key,
        "__bucket",
        "__which",
        "__pos",
        F.row_number().over(along).alias("__rank"),
        F.sum("__held").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__base"),
        F.col("__step"),
        F.sum("__step").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("__run"),
    ).withColumn("__after", F.col("__base") + F.col("__run"))
    before = F.col("__after") - F.col("__step")
    # The first row of a value also brings in what the bucket inherits at its start.
    entering = F.struct(
        F.col("__bucket").alias("__pos"),
        F.when(F.col("__base") > 0, 1).otherwise(0).alias("__kinds"),
        _copies_cost(F.col("__base")).alias("__cost"),
    )
    change = F.struct(
        F.col("__pos").alias("__pos"),
        (F.when(F.col("__after") > 0, 1).otherwise(0) - F.when(before > 0, 1).otherwise(0)).alias("__kinds"),
        (_copies_cost(F.col("__after")) - _copies_cost(before)).alias("__cost"),
    )
    first = (F.col("__rank") == 1) & (F.col("__base") > 0)
    return counted.select(
        key,
        "__bucket",
        "__which",
        F.inline_outer(F.when(first, F.array(entering, change)).otherwise(F.array(change))),
    ).where((F.col("__kinds") != 0) | (F.col("__cost") != 0))


def rolling_readings(
    df: DataFrame, key: str, features: Sequence[Rolling], window: str | int = "1s", ts: str = "ts"
) -> DataFrame:
    """One row per (key, ``__us``) with every requested feature."""
    w = window_micros(window)
    facts = df.withColumn("__us", event_micros(df, ts)).where(F.col(key).isNotNull() & F.col("__us").isNotNull())

    value_columns: list[str] = []
    for f in features:
        if f.kind in ("nunique", "entropy") and f.column not in value_columns:
            value_columns.append(f.column)
    counted = [c for c in dict.fromkeys(f.column for f in features if f.kind in ("count", "mean", "entropy"))]
    summed = [c for c in dict.fromkeys(f.column for f in features if f.kind in ("sum", "mean"))]
    measures = {f"n{i}": F.count(c) for i, c in enumerate(counted)}
    measures |= {f"s{i}": F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)) for i, c in enumerate(summed)}

    ticks = facts.groupBy(key, "__us").agg(
        F.count(F.lit(1)).alias("__rows"), *[agg.alias(f"__m_{m}") for m, agg in measures.items()]
    )
    zero = {m: (F.lit(0).cast("long") if m.startswith("n") else F.lit(0.0)) for m in measures}

    def placed(position: Column, probe: int, own: bool) -> Column:
        kept = {m: F.col(f"__m_{m}") for m in measures}
        return F.struct(
            position.alias("__pos"),
            F.lit(probe).alias("__probe"),
            *[(kept[m] if own else zero[m]).alias(f"__own_{m}") for m in measures],
            *[(zero[m] if own else kept[m]).alias(f"__old_{m}") for m in measures],
        )

    kept_columns = ["__pos", "__probe", *[f"__own_{m}" for m in measures], *[f"__old_{m}" for m in measures]]
    if measures:
        placed_ticks = _spread(
            ticks, w, placed(F.col("__us"), 1, True), placed(F.col("__us") + w, 0, False)
        )
    else:  # value features alone only need to know where to read
        placed_ticks = ticks.withColumns({"__pos": F.col("__us"), "__probe": F.lit(1)}).withColumn(
            "__bucket", F.col("__pos") - F.pmod(F.col("__pos"), F.lit(w))
        )
    timeline = placed_ticks.select(key, "__bucket", *kept_columns)
    if value_columns:
        changes = []
        for i in range(len(value_columns)):
            here = F.col("__which") == i
            changes += [
                F.sum(F.when(here, F.col("__kinds")).otherwise(0).cast("long")).alias(f"__own_k{i}"),
                F.sum(F.when(here, F.col("__cost")).otherwise(0.0)).alias(f"__own_e{i}"),
            ]
        # All changes at one position become one row, however many values change there.
        steps = _value_changes(facts, key, value_columns, w).groupBy(key, "__bucket", "__pos").agg(*changes)
        timeline = timeline.unionByName(steps.withColumn("__probe", F.lit(0)), allowMissingColumns=True)
    own = [c for c in timeline.columns if c.startswith("__own_")]
    old = [c for c in timeline.columns if c.startswith("__old_")]

    # At one position the reading row comes after the changes and before (in the backward
    # order, first of all) the rows that leave the frame there.
    bucket = Window.partitionBy(key, "__bucket")
    upto = bucket.orderBy("__pos", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    later = bucket.orderBy(F.col("__pos").desc(), F.col("__probe").desc()).rowsBetween(Window.unboundedPreceding, -1)
    read = timeline.withColumns({c: F.sum(c).over(upto) for c in own})
    if old:
        read = read.withColumns({c: F.sum(c).over(later) for c in old})
    read = read.where(F.col("__probe") == 1)

    def additive(tag: str, empty) -> Column:
        return F.coalesce(F.col(f"__own_{tag}"), empty) + F.coalesce(F.col(f"__old_{tag}"), empty)

    def feature(f: Rolling) -> Column:
        n = additive(f"n{counted.index(f.column)}", F.lit(0).cast("long")) if f.column in counted else None
        s = additive(f"s{summed.index(f.column)}", F.lit(0.0)) if f.column in summed else None
        if f.kind == "count":
            return n
        if f.kind == "sum":
            return s
        if f.kind == "mean":
            return F.when(n > 0, s / n)
        i = value_columns.index(f.column)
        kinds = F.coalesce(F.col(f"__own_k{i}"), F.lit(0).cast("long"))
        if f.kind == "nunique":
            return kinds
        cost = F.coalesce(F.col(f"__own_e{i}"), F.lit(0.0))
        # One value (or none) has no entropy; saying so avoids a -0.0 or a rounding speck.
        return F.when(kinds > 1, F.log2(n) - cost / n).otherwise(F.lit(0.0))

    return read.select(key, F.col("__pos").alias("__us"), *[feature(f).alias(f.name) for f in features])


def rolling_by(
    df: DataFrame, plan: dict[str, Sequence[Rolling]], window: str | int = "1s", ts: str = "ts"
) -> DataFrame:
    """``df`` with the features of every key in ``plan``; null where the key or the time is null.

    All readings are taken from ``df`` itself, so no key's timeline waits for another's join.
    """
    out = df.withColumn("__us", event_micros(df, ts))
    for key, features in plan.items():
        out = out.join(rolling_readings(df, key, features, window, ts), [key, "__us"], "left")
    return out.select(*df.columns, *[f.name for features in plan.values() for f in features])


def rolling(
    df: DataFrame, key: str, features: Sequence[Rolling], window: str | int = "1s", ts: str = "ts"
) -> DataFrame:
    """``df`` with one column per feature of one key."""
    return rolling_by(df, {key: features}, window, ts)


def rolling_framed(
    df: DataFrame,
    key: str,
    aggregates: dict[str, Column],
    window: str | int = "1s",
    ts: str = "ts",
    row_id: str = "flow_id",
) -> DataFrame:
    """Any aggregate ``Column`` (built-in or a grouped-aggregate pandas UDF) over the frame.

    The general form for aggregates without a running-sum shape. Every row is copied to the
    bucket after its own, frames run per (key, bucket), and each row is kept from the bucket
    that is its own, so a hot key is spread over its time buckets.
    """
    w = window_micros(window)
    us = event_micros(df, ts)
    frame = Window.partitionBy(key, "__bucket").orderBy("__us").rangeBetween(-(w - 1), 0)
    own = F.col("__us") - F.pmod(F.col("__us"), F.lit(w))
    copied = (
        df.withColumn("__us", us)
        .where(F.col(key).isNotNull() & F.col("__us").isNotNull())
        .withColumn("__bucket", F.explode_outer(F.array(own, own + w)))
        .withColumns({name: agg.over(frame) for name, agg in aggregates.items()})
        .where(F.col("__bucket") == own)
        .drop("__us", "__bucket")
    )
    keyless = df.where(F.col(key).isNull() | us.isNull())
    return copied.unionByName(keyless, allowMissingColumns=True)


def source_features(window_name: str = "1s") -> list[Rolling]:
    """The features computed per source address."""
    return [
        Rolling(f"Flows_per_SrcIP_{window_name}", "count", "dst_port"),
        Rolling(f"Bytes_per_SrcIP_{window_name}", "sum", "flow_bytes_s"),
        Rolling(f"Unique_DstPorts_per_SrcIP_{window_name}", "nunique", "dst_port"),
        Rolling(f"Unique_DstIPs_per_SrcIP_{window_name}", "nunique", "dst_ip"),
        Rolling(f"Unique_SrcPorts_per_SrcIP_{window_name}", "nunique", "src_port"),
        Rolling(f"Entropy_DstPorts_per_SrcIP_{window_name}", "entropy", "dst_port"),
        Rolling(f"Avg_FlowDuration_per_SrcIP_{window_name}", "mean", "flow_duration"),
    ]


def destination_features(window_name: str = "1s") -> list[Rolling]:
    """The features computed per destination address."""
    return [
        Rolling(f"Flows_per_DstIP_{window_name}", "count", "src_port"),
        Rolling(f"Bytes_per_DstIP_{window_name}", "sum", "flow_bytes_s"),
        Rolling(f"Unique_SrcIPs_per_DstIP_{window_name}", "nunique", "src_ip"),
    ]
