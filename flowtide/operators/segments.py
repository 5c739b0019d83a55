"""Ordered per-key computations that stay balanced when one key holds a large share of rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. These helpers cut every
key into segments along the order (a time bucket, a hash prefix, a value range), run the
window per (key, segment) and carry a one-row summary of each segment to the later ones.
The summaries are aggregated map-side first, so a hot key costs one small row per segment.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.session import materialize

_SEG = "__segment"
#: Rows a segment should hold, and the parts into which a table, and then a part of it, is cut at most.
ROWS_PER_CUT, FAN = 250_000, 1024
#: Size of a quantile sketch (its rank error, about 0.04 %, is well below one part in ``FAN``), and the groups in
#: which sketches of tasks are merged.
_SKETCH, _MERGES = 16_384, 64


def _sketch(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``by``, row count ``n``, smallest and largest of the first column and a quantile sketch ``s_x`` of each
    column. Sketches of tasks are merged in groups first, so no task meets those of all others."""
    named = df.select(*by, *[c.cast("double").alias(f"v_{x}") for x, c in columns.items()], F.pmod(F.spark_partition_id(), F.lit(_MERGES)).alias("__part"))
    first = f"v_{next(iter(columns))}"
    parts = named.groupBy(*by, "__part").agg(
        F.count(F.lit(1)).alias("n"), F.min(first).alias("low"), F.max(first).alias("high"),
        *[F.kll_sketch_agg_double(f"v_{x}", _SKETCH).alias(f"s_{x}") for x in columns])
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.kll_merge_agg_double(f"s_{x}", _SKETCH).alias(f"s_{x}") for x in columns])


def _quantiles(sketch: str, pieces: int) -> Column:
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, shares))


def _place(bounds: Column, value: Column) -> Column:
    """How many of the sorted ``bounds`` (fewer than 2 * ``FAN``) are at or below ``value``: a binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((2 * FAN - 1).bit_length()))])
    size = F.size(bounds)

    def step(at: Column, width: Column) -> Column:
        onto = at + width
        return F.when((onto <= size) & (F.get(bounds, onto - 1) <= value), onto).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def even_cuts(
    df: DataFrame, column: str, tie: str | None = None, rows: int = ROWS_PER_CUT, fan: int = FAN, out: str = "__cut"
) -> DataFrame:
    """Add a segment ``out``, a struct of ``cut`` and ``sub`` that does not decrease along (``column``, ``tie``)
    and holds about ``rows`` rows, however the values are spread and however many rows there are.

    Both columns are numbers. Quantile sketches set the cuts, at most ``fan`` of them. A value frequent enough to
    fill a cut gets one of its own. Cuts that are still too large are cut again, in up to ``fan`` parts each, along
    the column, or along ``tie`` where a cut holds one value. Nulls come first, as in an ascending order. Without
    ``tie``, rows of one value stay together.
    """
    value = F.col(column).cast("double")
    facts = _sketch(df, {"value": F.col(column)}).select("n", _quantiles("s_value", fan).alias("q")).first()
    pieces = min(fan, -(-(facts["n"] or 0) // rows))
    every = facts["q"] or []
    taken = [every[max(0, -(-i * fan // pieces) - 1)] for i in range(1, pieces)] if every else []
    bounds = {b for b in taken if math.isfinite(b)}
    bounds |= {math.nextafter(b, math.inf) for b in bounds if taken.count(b) > 1}
    listed = F.array(*[F.lit(b) for b in sorted(bounds)]).cast("array<double>")
    cut = F.when(value.isNull(), F.lit(-1)).otherwise(_place(listed, value))
    one = df.withColumn("__top", cut)
    large = pieces == fan or len(bounds) > len(set(taken))
    if not large:
        return one.withColumn(out, F.struct(F.col("__top").alias("cut"), F.lit(0).alias("sub"))).drop("__top")
    columns = {"value": F.col(column)} | ({"tie": F.col(tie)} if tie else {})
    sizes = _sketch(one, columns, ["__top"]).where(F.col("n") > 2 * rows)
    same = F.col("low").isNull() | (F.col("low") == F.col("high"))
    by_tie = same if tie else F.lit(False)
    chosen = F.when(by_tie, _quantiles("s_tie" if tie else "s_value", fan)).otherwise(_quantiles("s_value", fan))
    each = F.greatest(F.lit(1), F.floor(F.lit(fan) * rows / F.col("n")).cast("int"))
    thinned = F.array_distinct(F.filter(chosen, lambda _, i: (i + 1) % F.col("each") == 0))
    inner = sizes.withColumn("each", each).select(
        F.col("__top").alias("__of"), by_tie.alias("__by_tie"), thinned.alias("__bounds"))
    # written, as sketches are random: a task that runs again must find the same bounds
    joined = one.join(materialize(inner, "cuts"), F.col("__top") == F.col("__of"), "left")
    along = F.when(F.col("__by_tie"), F.col(tie).cast("double")).otherwise(value) if tie else value
    sub = F.when(F.col("__bounds").isNull(), F.lit(0)).otherwise(F.coalesce(_place(F.col("__bounds"), along), F.lit(0)))
    return joined.withColumn(out, F.struct(F.col("__top").alias("cut"), sub.alias("sub"))).drop("__top", "__of", "__by_tie", "__bounds")


def numbered(
    df: DataFrame, column: str, order: Sequence[Column], tie: str | None = None, rows: int = ROWS_PER_CUT, fan: int = FAN, out: str = "n"
) -> DataFrame:
    """``row_number()`` over the whole table in ``order``, which begins with ``column``, and no task that sees all
    of it: parts are numbered on their own, and the driver adds up the sizes of the few cuts."""
    cut = even_cuts(df, column, tie, rows, fan).withColumn("__top", F.col("__cut.cut"))
    sizes = sorted(tuple(r) for r in cut.groupBy("__top").agg(F.count(F.lit(1))).collect())
    starts = [(top, sum(n for _, n in sizes[:i])) for i, (top, _) in enumerate(sizes)]
    before = df.sparkSession.createDataFrame(starts, "__at int, __before long")
    ranks = ranked(cut, ["__top"], F.col("__cut.sub"), order, out)
    return (
        ranks.join(before, F.col("__top") == F.col("__at"))
        .withColumn(out, F.col(out) + F.col("__before"))
        .drop("__cut", "__top", "__at", "__before")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that treats null keys as equal; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def ranked(
    df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[Column], out: str = "rn"
) -> DataFrame:
    """``row_number()`` per key in ``order``, 1-based. ``segment`` must not decrease along it."""
    keys = list(keys)
    cut = df.withColumn(_SEG, segment)
    sizes = cut.groupBy(*keys, _SEG).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, _SEG, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    local = Window.partitionBy(*keys, _SEG).orderBy(*order)
    numbered = cut.withColumn("__local", F.row_number().over(local))
    return (
        null_safe_join(numbered, starts, [*keys, _SEG])
        .withColumn(out, F.col("__start") + F.col("__local"))
        .drop(_SEG, "__local", "__start")
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[Column], sums: dict[str, str]
) -> DataFrame:
    """Running totals (current row included) per key; ``sums`` maps output to input column."""
    keys = list(keys)
    cut = df.withColumn(_SEG, segment)
    totals = cut.groupBy(*keys, _SEG).agg(*[F.sum(src).alias(f"__t_{out}") for out, src in sums.items()])
    before = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        _SEG,
        *[F.coalesce(F.sum(f"__t_{out}").over(before), F.lit(0)).alias(f"__c_{out}") for out in sums],
    )
    upto = Window.partitionBy(*keys, _SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"__l_{out}": F.sum(src).over(upto) for out, src in sums.items()})
    joined = null_safe_join(local, carried, [*keys, _SEG])
    return joined.withColumns({out: F.col(f"__l_{out}") + F.col(f"__c_{out}") for out in sums}).drop(
        _SEG, *[f"__l_{o}" for o in sums], *[f"__c_{o}" for o in sums]
    )


def last_known(
    df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its key (``order`` ascending)."""
    keys = list(keys)
    cut = df.withColumn(_SEG, segment)
    rank = F.struct(*order)
    tails = (
        cut.where(F.col(value).isNotNull())
        .groupBy(*keys, _SEG)
        .agg(F.max_by(value, rank).alias("__tail"))
    )
    # Every segment present needs the carry, so keep those without an observation too.
    present = cut.groupBy(*keys, _SEG).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    before = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = null_safe_join(present, tails, [*keys, _SEG]).select(
        *keys, _SEG, F.last("__tail", ignorenulls=True).over(before).alias("__carry")
    )
    upto = Window.partitionBy(*keys, _SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__seen", F.last(value, ignorenulls=True).over(upto))
    return (
        null_safe_join(local, carried, [*keys, _SEG])
        .withColumn(out, F.coalesce("__seen", "__carry"))
        .drop(_SEG, "__seen", "__carry")
    )
