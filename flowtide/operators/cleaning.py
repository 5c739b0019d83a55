"""Column selection and row cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_selected_features(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Only the named columns that exist, and the label, in the frame's own order."""
    wanted = {*features, label}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in wanted])


def drop_irrelevant_features(df: DataFrame, names: str) -> DataFrame:
    """Drop a comma-separated list of columns, or nothing at all if any name is unknown."""
    asked = [n.strip() for n in names.split(",") if n.strip()]
    unknown = [n for n in asked if n not in df.columns]
    if unknown:
        raise ValueError(f"not columns of the table: {unknown}")
    return df.drop(*asked)


def align_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The training columns in training order; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing for scoring: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def _fractional(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows holding a null, a NaN or an infinity in any column."""
    conditions = [F.col(f"`{c}`").isNotNull() for c in df.columns]
    for c in _fractional(df):
        conditions.append(~F.isnan(f"`{c}`") & (F.abs(F.col(f"`{c}`")) != float("inf")))
    return df.where(reduce(lambda a, b: a & b, conditions))


def constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    """Columns with exactly one distinct non-null value, from one min/max pass."""
    names = [c for c in df.columns if c not in keep]
    if not names:
        return []
    bounds = df.agg(
        *[F.min(f"`{c}`").eqNullSafe(F.max(f"`{c}`")).alias(f"e{i}") for i, c in enumerate(names)],
        *[F.min(f"`{c}`").isNotNull().alias(f"p{i}") for i, c in enumerate(names)],
    ).first()
    return [c for i, c in enumerate(names) if bounds[f"e{i}"] and bounds[f"p{i}"]]


def drop_constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.drop(*constant_columns(df, keep))


def drop_rare_classes(df: DataFrame, label: str, min_frequency_threshold: int = 10) -> DataFrame:
    """Keep rows of classes with at least the given number of rows.

    The counts are one row per class after map-side aggregation; Spark broadcasts them only
    while they are under its own size limit.
    """
    frequent = (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= min_frequency_threshold)
        .select(label)
    )
    return df.join(frequent, label, "left_semi")


def clean_data(df: DataFrame, label: str, min_frequency_threshold: int = 10) -> DataFrame:
    """Incomplete rows, duplicates, constant columns and rare classes, removed in that order.

    The label is never dropped, even when it is constant.
    """
    complete = drop_incomplete(df).dropDuplicates()
    # The constant test is unaffected by duplicates, so it reads the rows before the shuffle.
    varied = complete.drop(*constant_columns(drop_incomplete(df), keep=[label]))
    return drop_rare_classes(varied, label, min_frequency_threshold)


def clean_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strip commas and single quotes and read the columns as doubles; unreadable becomes null."""
    return df.withColumns(
        {
            c: F.regexp_replace(F.col(f"`{c}`").cast("string"), "[,']", "").try_cast("double")
            for c in columns
        }
    )
