"""Knowledge memory, retrieval votes and evaluation tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.operators.neighbors import nearest, neighbour_vote
from flowtide.operators.voting import VOTERS, hard_vote

# Fixed value: retrieval depth.
RETRIEVED = 5


def memory_candidates(predictions: DataFrame, truths: DataFrame, row_id: str, truth: str, limit: int | None = None) -> DataFrame:
    """Rows answered correctly; with ``limit``, those among the first ``limit`` predictions by id."""
    if limit is not None:
        predictions = predictions.orderBy(row_id).limit(limit)
    correct = predictions.join(truths, row_id).where(F.col("prediction") == F.col(truth))
    return correct.select(row_id, truth)


def mitigation_memory(threats: DataFrame, mitigations: DataFrame, row_id: str, limit: int | None = None) -> DataFrame:
    """The threats (with ``limit``, the first by id) with the mitigation known to have worked, if any;
    only those with one are remembered (``remember`` is true)."""
    first = threats if limit is None else threats.orderBy(row_id).limit(limit)
    return first.join(mitigations, row_id, "left").withColumn("remember", F.col("mitigation").isNotNull())


def resolve_low_agreement(
    undecided: DataFrame, memory: DataFrame, row_id: str, label: str, k: int = RETRIEVED, vector: str = "embedding"
) -> DataFrame:
    """Label of each undecided row by the vote of its most similar remembered rows."""
    references = memory.withColumnRenamed(row_id, "reference_id")
    found = nearest(undecided.withColumnRenamed(row_id, "query_id"), references, k, "cosine", vector=vector)
    voted = neighbour_vote(found, references, label)
    return voted.select(F.col("query_id").alias(row_id), F.col("prediction").alias("resolved"))


def apply_hook(df: DataFrame, hook: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user's batch function (an embedding model, a resolver) over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield hook(batch)

    return df.mapInPandas(run, schema)


def hashed_terms(df: DataFrame, text: str, width: int = 256, out: str = "embedding") -> DataFrame:
    """Offline default embedding: L2-normalised counts of hashed lower-case words."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("__words", F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""))
    counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=width).transform(words)
    unit = Normalizer(inputCol="__tf", outputCol="__unit").transform(counted)
    return unit.withColumn(out, vector_to_array("__unit", dtype="float32")).drop("__words", "__tf", "__unit")


def evaluation_rows(votes: DataFrame, scored: DataFrame, row_id: str, voters: Sequence[str] = VOTERS) -> DataFrame:
    """One row per sample: truth, majority, agreement, every voter's answer, text scores."""
    voted = hard_vote(votes, voters).join(scored, row_id, "left")
    return voted.select(
        F.col(row_id).alias("sample_index"),
        F.col("truth").alias("true_label"),
        F.col("majority").alias("majority_prediction"),
        "agreement_ratio",
        *[F.col(v).alias(f"{v}_prediction") for v in voters],
        "relevance",
        "faithfulness",
    )


def evaluation_summary(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """Mean relevance and faithfulness; missing scores are left out."""
    means = {c: F.avg(c) for c in ("relevance", "faithfulness")}
    return rows.agg(*[(F.round(m, digits) if digits is not None else m).alias(c) for c, m in means.items()])


def feature_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Absolute correlation of each feature with the target, 0 for a constant feature."""
    wide = df.agg(
        *[
            F.coalesce(F.nanvl(F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))), F.lit(0.0)), F.lit(0.0)).alias(f"f{i}")
            for i, c in enumerate(features)
        ]
    )
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("score")) for i, c in enumerate(features)]
    return wide.select(F.inline(F.array(*cells)))


def select_features(df: DataFrame, features: Sequence[str], target: str, threshold: float) -> DataFrame:
    """Drop the features that score below the threshold."""
    scores = {r["feature"]: r["score"] for r in feature_scores(df, features, target).collect()}
    return df.drop(*[c for c in features if scores[c] < threshold])
