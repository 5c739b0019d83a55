"""Dataset profile: per-column statistics in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, nulls, text bytes, smallest and largest text per column (long form)."""
    names = df.columns
    text = {c: F.col(f"`{c}`").cast("string") for c in names}
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        aggregates += [
            F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls{i}"),
            F.coalesce(F.sum(F.octet_length(text[c])), F.lit(0)).cast("long").alias(f"bytes{i}"),
        ]
    wide = df.agg(*aggregates)
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(c).alias("column_name"),
                        F.col("rows").alias("n_rows"),
                        F.col(f"nulls{i}").alias("n_nulls"),
                        F.col(f"bytes{i}").alias("text_bytes"),
                    )
                    for i, c in enumerate(names)
                ]
            )
        )
    )


def column_cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, exact or sketched.

    The exact form tags each cell with its column and counts distinct pairs, so a column's
    values are spread over tasks by value and repeated cells collapse map-side.
    """
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(df.columns)])
        cells = [
            F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(df.columns)
        ]
        return wide.select(F.inline(F.array(*cells)))
    tagged = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns]
    )
    pairs = df.select(F.inline(tagged)).distinct()
    return pairs.groupBy("column_name").agg(F.count("v").alias("n_distinct"))
