"""Scaling, one-hot and label encoding as fitted column expressions.

Fitting collects statistics and dictionaries only, never rows. A dictionary is read through a
limit one above its bound, so a column with too many categories fails instead of growing the
driver; such columns belong in ``dictionaries.SparseEncoder`` or, hashed, in ``vector_stage``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CATEGORIES = 10_000


def distinct_sorted(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list:
    """Sorted distinct non-null values of a column known to be small; an error beyond ``limit``."""
    rows = (
        df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories; encode it with dictionaries.SparseEncoder")
    return sorted(r[0] for r in rows)


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of mean and population standard deviation per column (long form)."""
    wide = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


@dataclass
class FlowEncoder:
    """Standard scaling of numbers and one-hot encoding of categories, fitted on training rows."""

    numeric: dict[str, tuple[float, float]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def fit(
        cls, df: DataFrame, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None
    ) -> FlowEncoder:
        """Numbers and booleans are scaled, strings one-hot encoded, unless columns are named."""
        if numeric is None:
            numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        if categorical is None:
            categorical = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        stats = {}
        if numeric:
            for row in scaler_stats(df, numeric).collect():
                mean, std = row["mean"] or 0.0, row["std"] or 0.0
                stats[row["column_name"]] = (mean, std if std > 0 else 1.0)
        return cls(stats, {c: distinct_sorted(df, c) for c in categorical})

    def feature_names(self) -> list[str]:
        """Output columns: categories first (``column_value``), then the scaled numbers."""
        encoded = [f"{c}_{value}" for c, values in self.categories.items() for value in values]
        return encoded + list(self.numeric)

    def transform(self, df: DataFrame) -> DataFrame:
        """Pass-through columns, then one column per feature; unseen categories are all zeros."""
        consumed = {*self.numeric, *self.categories}
        kept = [F.col(f"`{c}`") for c in df.columns if c not in consumed]
        encoded = [
            F.coalesce((F.col(c) == value).cast("double"), F.lit(0.0)).alias(f"{c}_{value}")
            for c, values in self.categories.items()
            for value in values
        ]
        scaled = [
            ((F.col(c).cast("double") - F.lit(mean)) / F.lit(std)).alias(c) for c, (mean, std) in self.numeric.items()
        ]
        return df.select(*kept, *encoded, *scaled)

    def assemble_encoded(self, encoded: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        """``keep`` columns and one feature vector of already transformed rows."""
        assembler = VectorAssembler(inputCols=self.feature_names(), outputCol=out, handleInvalid="keep")
        return assembler.transform(encoded).select(*keep, out)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "document string").write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FlowEncoder:
        document = json.loads(spark.read.schema("document string").json(path).first()["document"])
        return cls({c: tuple(v) for c, v in document["numeric"].items()}, document["categories"])


def vector_stage(numeric: Sequence[str], categorical: Sequence[str], width: int = 1 << 18) -> Pipeline:
    """Feature vectors for high-cardinality categories (addresses): hashed, no dictionary."""
    hashed = FeatureHasher(inputCols=list(categorical), outputCol="__hashed", numFeatures=width)
    joined = VectorAssembler(inputCols=[*numeric, "__hashed"], outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[hashed, joined])


@dataclass
class LabelCodes:
    """Class names to codes in sorted order, and back."""

    classes: list[str]

    @classmethod
    def fit(cls, df: DataFrame, label: str) -> LabelCodes:
        return cls(distinct_sorted(df, label))

    def encode(self, df: DataFrame, label: str, out: str = "label_code") -> DataFrame:
        """Add integer codes; a class that was not fitted fails the job."""
        listed = F.array(*[F.lit(c) for c in self.classes])
        code = F.array_position(listed, F.col(label)).cast("int")
        unknown = F.raise_error(F.concat(F.lit("label not seen in training: "), F.col(label))).cast("int")
        return df.withColumn(out, F.when(F.col(label).isNull(), F.lit(None)).when(code > 0, code - 1).otherwise(unknown))

    def decode(self, df: DataFrame, code: str, out: str = "label") -> DataFrame:
        listed = F.array(*[F.lit(c) for c in self.classes])
        return df.withColumn(out, F.element_at(listed, F.col(code).cast("int") + 1))
