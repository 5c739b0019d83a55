"""Category codes for columns of any size: a written dictionary that rows are joined to, and sparse vectors.

``FlowEncoder`` makes a column per category and keeps the categories in the plan, which suits labels and
protocols. For addresses and other columns without a bound on their values, a dictionary is a table: its values
are dealt by range and numbered there, rows find their code by an equi-join, and a vector stores only the one
position that is set. The driver holds the number of categories of a column and never a category.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.operators.encoding import scaler_stats
from flowtide.operators.segments import ranked
from flowtide.session import materialize

UNSEEN = ("null", "fail", "last")


@dataclass
class Dictionary:
    """Codes of the distinct non-null values of some columns: 0, 1, ... in sorted order for each column.

    ``table`` has ``column_name``, ``value`` (as text) and ``code``; ``sizes`` the number of values of each column.
    """

    table: DataFrame
    sizes: dict[str, int]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Dictionary:
        """Duplicates collapse before the shuffle. Values are sorted as text and dealt by range, so that a part's
        number grows along the order; each part is then numbered on its own behind the sizes of earlier parts."""
        listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
        values = df.select(F.inline(listed)).where(F.col("value").isNotNull()).distinct()
        dealt = materialize(
            values.repartitionByRange("column_name", "value").withColumn("part", F.spark_partition_id()), "dictionary-values")
        coded = ranked(dealt, ["column_name"], F.col("part"), [F.col("value")], "code")
        table = materialize(coded.select("column_name", "value", (F.col("code") - 1).alias("code")), "dictionary")
        sizes = {r["column_name"]: r["n"] for r in table.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        return cls(table, {c: sizes.get(c, 0) for c in columns})

    def _of(self, column: str) -> DataFrame:
        return self.table.where(F.col("column_name") == column).select(F.col("value").alias("__value"), F.col("code").alias("__code"))

    def encode(self, df: DataFrame, column: str, out: str, unseen: str = "null") -> DataFrame:
        """Add the code (long) of ``column``. A null stays null; a value that was not fitted becomes null, fails
        the job, or gets the number of values (``last``).

        A frequent value is no hot group: the dictionary has one row for each value, so the side with the rows
        may be broadcast to or split by adaptive execution.
        """
        if unseen not in UNSEEN:
            raise ValueError(f"unseen must be one of {UNSEEN}")
        value = F.col(f"`{column}`").cast("string")
        joined = df.join(self._of(column), value == F.col("__value"), "left")
        missing: Column = F.lit(None).cast("long")
        if unseen == "fail":
            missing = F.raise_error(F.concat(F.lit(f"{column} not seen in training: "), value)).cast("long")
        elif unseen == "last":
            missing = F.lit(self.sizes[column]).cast("long")
        code = F.when(value.isNull(), F.lit(None).cast("long")).when(F.col("__code").isNull(), missing).otherwise(F.col("__code"))
        return joined.withColumn(out, code).drop("__value", "__code")

    def decode(self, df: DataFrame, code: str, column: str, out: str) -> DataFrame:
        """Add the value (text) behind a code of ``column``; null for a code that has none."""
        joined = df.join(self._of(column), F.col(f"`{code}`") == F.col("__code"), "left")
        return joined.withColumn(out, F.col("__value")).drop("__value", "__code")

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").partitionBy("column_name").parquet(f"{path}/values")
        sizes = self.table.sparkSession.createDataFrame(list(self.sizes.items()), "column_name string, n long")
        sizes.write.mode("overwrite").parquet(f"{path}/sizes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        sizes = {r["column_name"]: r["n"] for r in spark.read.parquet(f"{path}/sizes").collect()}
        table = spark.read.schema("value string, code long, column_name string").parquet(f"{path}/values")
        return cls(table, sizes)


@dataclass
class SparseEncoder:
    """Scaled numbers behind one-hot categories of any number, as one sparse vector: the categories of each
    column in the order given, then the numbers. A null or unseen category sets no position."""

    dictionary: Dictionary
    numeric: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> SparseEncoder:
        stats = {}
        for row in scaler_stats(df, numeric).collect() if numeric else []:
            mean, std = row["mean"] or 0.0, row["std"] or 0.0
            stats[row["column_name"]] = (mean, std if std > 0 else 1.0)
        return cls(Dictionary.fit(df, categorical), stats)

    @property
    def width(self) -> int:
        return sum(self.dictionary.sizes.values()) + len(self.numeric)

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """The columns of ``df`` and the vector."""
        filled = {c: n for c, n in self.dictionary.sizes.items() if n}
        coded, codes, places = df, [], []
        for i, (column, size) in enumerate(filled.items()):
            code = f"__code_{i}"
            coded = self.dictionary.encode(coded, column, code, "last")
            coded = coded.withColumn(code, F.coalesce(F.col(code), F.lit(size)).cast("double"))
            codes.append(code)
            places.append(f"__place_{i}")
        if codes:
            # fitted on one row that holds the largest codes; the code behind them sets no position
            largest = df.sparkSession.createDataFrame(
                [tuple(float(n - 1) for n in filled.values())], T.StructType([T.StructField(c, T.DoubleType()) for c in codes]))
            hot = OneHotEncoder(inputCols=codes, outputCols=places, handleInvalid="keep", dropLast=True).fit(largest)
            coded = hot.transform(coded)
        scaled = {f"__n_{i}": (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for i, (c, (m, s)) in enumerate(self.numeric.items())}
        coded = coded.withColumns(scaled) if scaled else coded
        made = VectorAssembler(inputCols=[*places, *scaled], outputCol=out, handleInvalid="keep").transform(coded)
        return made.select(*[F.col(f"`{c}`") for c in df.columns], out)

    def save(self, path: str) -> None:
        self.dictionary.save(f"{path}/dictionary")
        rows = [(i, c, m, s) for i, (c, (m, s)) in enumerate(self.numeric.items())]
        order = [(i, c) for i, c in enumerate(self.dictionary.sizes)]
        spark = self.dictionary.table.sparkSession
        spark.createDataFrame(rows, "i int, column_name string, mean double, std double").write.mode("overwrite").parquet(f"{path}/numeric")
        spark.createDataFrame(order, "i int, column_name string").write.mode("overwrite").parquet(f"{path}/order")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseEncoder:
        found = Dictionary.load(spark, f"{path}/dictionary")
        order = [r["column_name"] for r in spark.read.parquet(f"{path}/order").orderBy("i").collect()]
        numeric = spark.read.parquet(f"{path}/numeric").orderBy("i").collect()
        return cls(Dictionary(found.table, {c: found.sizes[c] for c in order}), {r["column_name"]: (r["mean"], r["std"]) for r in numeric})
