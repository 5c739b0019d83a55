"""Combining several classifiers' answers. Row-local: votes never shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Voter order (it breaks ties), recorded constant confidences, displayed names.
VOTERS = ["rfc", "xgb", "mlp", "knn"]
MALICIOUS_CONFIDENCE = 90.0
BENIGN_CONFIDENCE = 95.0
FIRST_VOTER_CONFIDENCE = 85.0
VOTER_CONFIDENCE_STEP = 2.0
RESOLVER_CONFIDENCE = 88.0
FALLBACK_CONFIDENCE = 95.0
DETECTOR_NAME = "Pre-Detection"
RESOLVER_NAME = "LLM Agent"
FALLBACK_NAME = "Network Agent System"


def hard_vote(df: DataFrame, voters: Sequence[str] = VOTERS) -> DataFrame:
    """Add ``majority``, ``top_votes``, ``low_agreement`` and ``agreement_ratio`` (percent).

    A tie for first place is low agreement; the class seen first in voter order still wins.
    """
    cast = F.array(*[F.col(v) for v in voters])
    counts = F.transform("__distinct", lambda c: F.size(F.filter("__votes", lambda v: v == c)))
    return (
        df.withColumn("__votes", F.filter(cast, lambda v: v.isNotNull()))
        .withColumn("__distinct", F.array_distinct("__votes"))
        .withColumn("__counts", counts)
        .withColumn("top_votes", F.array_max("__counts"))
        .withColumns(
            {
                "majority": F.get("__distinct", F.array_position("__counts", F.col("top_votes")).cast("int") - 1),
                "low_agreement": F.size(F.filter("__counts", lambda c: c == F.col("top_votes"))) > 1,
                "agreement_ratio": F.col("top_votes") / F.lit(len(voters)) * 100,
            }
        )
        .drop("__votes", "__distinct", "__counts")
    )


def soft_vote(df: DataFrame, probability_columns: Sequence[str], out: str = "mean_probability") -> DataFrame:
    """Mean of the classifiers' probability arrays, class by class."""
    n = len(probability_columns)
    total = F.col(probability_columns[0])
    for name in probability_columns[1:]:
        total = F.zip_with(total, F.col(name), lambda a, b: a + b)
    return df.withColumn(out, F.transform(total, lambda p: p / n))


def soft_vote_long(df: DataFrame, keys: Sequence[str], probability: str) -> DataFrame:
    """The same over long rows (row, classifier, class, probability)."""
    return df.groupBy(*keys).agg(F.avg(probability).alias("mean_probability"))


def low_agreement_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("low_agreement"))


def result_document(
    malicious: Column, voters: Sequence[tuple[str, Column]], majority: Column, agreement_ratio: Column,
    final: Column, used_resolver: Column,
) -> Column:
    """The nested result row of one sample; benign samples stop before the voters."""
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                prediction.cast("string").alias("prediction"),
                F.lit(FIRST_VOTER_CONFIDENCE + i * VOTER_CONFIDENCE_STEP).alias("confidence"),
            )
            for i, (name, prediction) in enumerate(voters)
        ]
    )
    return F.struct(
        F.struct(
            F.when(malicious, "Malicious").otherwise("Benign").alias("prediction"),
            F.when(malicious, MALICIOUS_CONFIDENCE).otherwise(BENIGN_CONFIDENCE).alias("confidence"),
        ).alias("pre_detection"),
        F.when(malicious, listed).alias("classifiers"),
        F.when(
            malicious,
            F.struct(majority.cast("string").alias("prediction"), agreement_ratio.alias("agreement_ratio")),
        ).alias("majority_vote"),
        F.when(malicious, final.cast("string")).otherwise("Benign").alias("final_prediction"),
        (malicious & used_resolver).alias("used_llm"),
    )


def classifier_list(result: Column) -> Column:
    """The report's voter list: pre-detection first, then voters, then the resolver if used."""
    before = F.struct(
        F.lit(DETECTOR_NAME).alias("name"),
        result["pre_detection"]["prediction"].alias("prediction"),
        result["pre_detection"]["confidence"].alias("confidence"),
    )
    resolver = F.struct(
        F.lit(RESOLVER_NAME).alias("name"),
        result["final_prediction"].alias("prediction"),
        F.lit(RESOLVER_CONFIDENCE).alias("confidence"),
    )
    listed = F.concat(
        F.array(before),
        F.coalesce(result["classifiers"], F.slice(F.array(before), 1, 0)),
        F.when(result["used_llm"], F.array(resolver)).otherwise(F.slice(F.array(before), 1, 0)),
    )
    fallback = F.array(
        F.struct(
            F.lit(FALLBACK_NAME).alias("name"),
            result["final_prediction"].alias("prediction"),
            F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
        )
    )
    return F.when(result["pre_detection"].isNull(), fallback).otherwise(listed)


def report_majority(result: Column) -> Column:
    """Majority class and agreement shown by the report; pre-detection alone agrees fully."""
    alone = F.struct(
        F.coalesce(result["pre_detection"]["prediction"], result["final_prediction"]).alias("prediction"),
        F.lit(100.0).alias("agreement_ratio"),
    )
    return F.coalesce(result["majority_vote"], alone)
