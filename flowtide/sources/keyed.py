"""Tables that take each key once: a batch that comes again, whole or in part, changes nothing.

A table lies in folders by the first digits of a hashed key (lower-case hex). A batch reads the keys of its own
folders only, drops what is stored, and appends the rest. Spark commits an append as a whole, so a batch that
failed half way is simply given again. Two writers must not append to one table at the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.session import path_exists

PART = "key_part"
#: Hex digits of the key that name a folder: 256 folders.
DIGITS = 2


def part_of(key: Column) -> Column:
    """The folder of a key. The letter in front keeps Spark from reading it as a number."""
    return F.concat(F.lit("p"), F.substring(key, 1, DIGITS))


def create_keyed(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Start the table afresh, empty. One folder without rows holds the columns, so it can be read at once."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    columns = T.StructType([f for f in schema.fields if f.name != PART])
    spark.createDataFrame([], columns).write.parquet(f"{path}/{PART}=p")


def stored_keys(batch: DataFrame, path: str, key: str) -> DataFrame:
    """The stored keys in the folders that ``batch`` touches: one narrow column, other folders are not opened."""
    touched = [r[0] for r in batch.select(part_of(F.col(key))).distinct().collect()]  # at most one a folder
    spark = batch.sparkSession
    kept = T.StructType([f for f in batch.schema.fields if f.name == key])
    stored = spark.read.schema(kept.add(PART, "string")).parquet(path)
    return stored.where(F.col(PART).isin(touched)).select(key)


def unstored(batch: DataFrame, path: str, key: str) -> DataFrame:
    """Rows of ``batch``, each key once, whose key the table does not hold. A null key is dropped."""
    fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
    if not path_exists(batch.sparkSession, path):
        return fresh
    return fresh.join(stored_keys(batch, path, key), key, "left_anti")


def append_keyed(fresh: DataFrame, path: str, key: str) -> None:
    """Append rows that ``unstored`` let through. Rows are dealt by folder, so that a batch leaves one file in each;
    keys are hashed, so folders are alike. A rebalance would do nothing in the batches of a stream, where adaptive
    execution is off, and every task would write into every folder."""
    if not path_exists(fresh.sparkSession, path):
        create_keyed(fresh.sparkSession, path, fresh.schema)
    dealt = fresh.withColumn(PART, part_of(F.col(key))).repartition(F.col(PART))
    dealt.write.mode("append").partitionBy(PART).parquet(path)
