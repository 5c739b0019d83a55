"""The two-stage cascade: detect, classify by four voters, resolve ties, document.

A row keeps its columns all the way. While the references of the neighbour voter and of the memory are few enough for
every task to hold them, nothing is joined back and no table is written, and the cascade scores a stream as it does a
table. More of them are compared by the exact neighbour join, and a stream is scored batch by batch.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import OneVsRestModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.operators import models, voting
from flowtide.operators.encoding import LabelCodes
from flowtide.operators.retrieval import RETRIEVED
from flowtide.operators.stages import EncoderStage, HighestStage, NeighbourStage
from flowtide.plans.training import Prepared, transform_data
from flowtide.session import materialize, spread

_DETECTION, _CLASSIFICATION = "__detection", "__classification"


def _named(model: Model, features: str, name: str) -> list[Transformer]:
    """Stages that read ``features`` and write columns of their own name."""
    if isinstance(model, OneVsRestModel):
        parts = [stage for i, m in enumerate(model.models) for stage in _named(m, features, f"__{name}{i}")]
        return [*parts, HighestStage(inputCols=[m.getRawPredictionCol() for m in parts], outputCol=name)]
    columns = {"featuresCol": features, "predictionCol": name, "rawPredictionCol": f"__{name}_raw", "probabilityCol": f"__{name}_probability"}
    return [model.copy({model.getParam(p): value for p, value in columns.items() if model.hasParam(p)})]


@dataclass
class Cascade:
    """Fitted pipelines of both stages and the memory that settles ties. It can be saved and loaded whole."""

    row_id: str
    classes: list[str]
    detector: PipelineModel
    classifier: PipelineModel
    memory: NeighbourStage

    def save(self, spark: SparkSession, path: str) -> None:
        for name in ("detector", "classifier", "memory"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        facts = json.dumps({"row_id": self.row_id, "classes": self.classes})
        spark.createDataFrame([(facts,)], "document string").write.mode("overwrite").json(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cascade:
        facts = json.loads(spark.read.schema("document string").json(f"{path}/facts").first()["document"])
        return cls(
            facts["row_id"], facts["classes"], PipelineModel.load(f"{path}/detector"), PipelineModel.load(f"{path}/classifier"),
            NeighbourStage.load(f"{path}/memory"))

    def vectors(self, df: DataFrame) -> DataFrame:
        """Rows with ``features``, as the voters see them."""
        return self.classifier.stages[0].transform(df).withColumnRenamed(_CLASSIFICATION, "features")


def prepare(df: DataFrame, label: str, row_id: str, numeric: list[str], categorical: list[str]) -> Prepared:
    return transform_data(df, label, row_id, numeric, categorical)


def labelled(prepared: Prepared, df: DataFrame, stage: str) -> DataFrame:
    """(row id, features, target) of one stage."""
    if stage == "detection":
        return prepared.detection.assemble_encoded(prepared.detection_rows(df), [prepared.row_id, "target"])
    return prepared.classification.assemble_encoded(prepared.classification_rows(df), [prepared.row_id, "target"])


def train_cascade(
    prepared: Prepared, forest_params: dict | None = None, boosting_rounds: int = models.BOOSTING_ROUNDS, epochs: int = models.MLP_EPOCHS, neighbours: int = 3
) -> Cascade:
    """Fit the detector and the voters. The encoded training rows are written once and shared
    by all fits. The neighbour voter and the memory compare with all of them."""
    params = forest_params or {"numTrees": 100, "maxDepth": 20}
    detection = materialize(spread(labelled(prepared, prepared.train, "detection")), "train-detection")
    attacks = materialize(spread(labelled(prepared, prepared.train, "classification")), "train-classification")
    fitted = {
        "rfc": models.fit_forest(attacks, **params),
        "xgb": models.fit_boosted(attacks, prepared.row_id, boosting_rounds),
        "mlp": models.fit_perceptron(attacks, len(prepared.codes.classes), prepared.row_id, epochs),
    }
    knn = NeighbourStage(neighbours, "euclidean", _CLASSIFICATION, "knn").remember(attacks, prepared.row_id)
    memory = NeighbourStage(RETRIEVED, "cosine", _CLASSIFICATION, "resolved", "low_agreement").sharing(knn)
    return Cascade(
        prepared.row_id,
        prepared.codes.classes,
        PipelineModel([EncoderStage.of(prepared.detection, _DETECTION), *_named(models.fit_forest(detection, **params), _DETECTION, "__malicious")]),
        PipelineModel([EncoderStage.of(prepared.classification, _CLASSIFICATION), *[s for n, m in fitted.items() for s in _named(m, _CLASSIFICATION, n)], knn]),
        memory,
    )


def _tidy(df: DataFrame) -> DataFrame:
    """Without the working columns of the stages."""
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def detect(cascade: Cascade, df: DataFrame) -> DataFrame:
    """All columns and ``is_malicious`` of the first stage."""
    return _tidy(cascade.detector.transform(df).withColumn("is_malicious", F.col("__malicious") == 1))


def classify(cascade: Cascade, malicious: DataFrame) -> DataFrame:
    """Votes, majority and resolved class code of rows found malicious."""
    rows = cascade.classifier.transform(malicious)
    voted = voting.hard_vote(rows.withColumns({v: F.col(v).cast("int") for v in voting.VOTERS}))
    if cascade.memory.table is not None:  # the join asks for the undecided rows first, so the votes are worked out once
        voted = materialize(voted.select(*[c for c in voted.columns if not c.startswith("__") or c == _CLASSIFICATION]), "voted")
    resolved = cascade.memory.transform(voted)
    return _tidy(resolved.withColumn("final_code", F.coalesce("resolved", "majority"))).drop("resolved")


def run_cascade(cascade: Cascade, df: DataFrame) -> DataFrame:
    """(row id, result document) of every row; only malicious rows reach the second stage."""
    first = detect(cascade, df)
    attacks = classify(cascade, first.where("is_malicious"))
    codes = LabelCodes(cascade.classes)
    for column in (*voting.VOTERS, "majority", "final_code"):
        attacks = codes.decode(attacks, column, column)
    document = voting.result_document(
        F.col("is_malicious"),
        [(v.upper(), F.col(v)) for v in voting.VOTERS],
        F.col("majority"),
        F.col("agreement_ratio"),
        F.col("final_code"),
        F.col("low_agreement"),
    )
    none = F.lit(None)
    benign = (
        first.where(~F.col("is_malicious"))
        .withColumns({v: none.cast("string") for v in (*voting.VOTERS, "majority", "final_code")})
        .withColumns({"agreement_ratio": none.cast("double"), "low_agreement": F.lit(False)})
    )
    return attacks.select(cascade.row_id, document.alias("result")).unionByName(benign.select(cascade.row_id, document.alias("result")))
