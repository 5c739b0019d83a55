"""Classifiers of both stages, on Spark ML, over (features, target) rows.

Differences from the models these replace: depth is capped at 30 by Spark's trees, boosted
trees are one-vs-rest, and the perceptron uses sigmoid layers with L-BFGS.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.vectors import softmax
from flowtide.operators import perceptron
from flowtide.operators.metrics import class_weights
from flowtide.operators.neighbors import nearest, neighbour_vote
from flowtide.operators.sampling import stratified_folds
from flowtide.session import materialize, path_exists

# Seed, search space, trial and fold numbers, training limits.
SEED = 42
FOREST_SPACE = {
    "numTrees": [50, 100, 150],
    "maxDepth": [20, 30],
    "minInstancesPerNode": [1, 2, 3, 4],
    "minWeightFractionPerNode": [0.0, 0.01, 0.02, 0.03, 0.04],
    "featureSubsetStrategy": ["sqrt", "log2"],
    "bootstrap": [True, False],
}
BINARY_TRIALS, BINARY_FOLDS = 30, 5
MULTI_TRIALS, MULTI_FOLDS = 30, 10
KNN_NEIGHBOURS = [3, 6, 9]
KNN_METRICS = ["euclidean", "manhattan", "chebyshev", "minkowski"]
KNN_TRIALS, KNN_FOLDS = 10, 5
BOOSTING_ROUNDS = 100
# Boosters of so many classes are fitted side by side, each with all rows in memory (four of them 1.1 kB a row); beyond
# so many rows one after the other, as each of them has work for all cores.
BOOSTERS_AT_ONCE = 4
BOOSTED_ROWS_AT_ONCE = 10_000_000
MLP_HIDDEN = [128, 64]
MLP_EPOCHS = 100
MLP_BLOCK = 512
MLP_PATIENCE = 7
MLP_FOLDS = 10
# Epochs between two looks at the held-out rows; patience is in epochs too.
MLP_STEP = 5
# Beyond so many training rows the same epochs are worked out by ``perceptron`` instead of Spark ML.
MLP_ROWS = 100_000


def with_class_weights(df: DataFrame, target: str = "target", out: str = "weight") -> DataFrame:
    """Balanced class weights as a column; the table behind it has one row per class."""
    pairs = [(r["label"], r["weight"]) for r in class_weights(df, target).collect()]
    weights = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return df.withColumn(out, weights[F.col(target)])


def forest(**params) -> RandomForestClassifier:
    """A class-weighted random forest."""
    return RandomForestClassifier(featuresCol="features", labelCol="target", weightCol="weight", seed=SEED, **params)


def fit_forest(train: DataFrame, **params) -> Model:
    return forest(**params).fit(with_class_weights(train))


def fit_boosted(train: DataFrame, row_id: str, rounds: int = BOOSTING_ROUNDS, validation_fraction: float = 0.1, **params) -> Model:
    """One-vs-rest boosted trees that stop early on a held-out share of the training rows."""
    from flowtide.operators.sampling import with_split

    held = with_split(train, row_id, validation_fraction, SEED + 1).withColumnRenamed("is_test", "is_validation")
    booster = GBTClassifier(featuresCol="features", labelCol="target", maxIter=rounds, validationIndicatorCol="is_validation", seed=SEED, **params)
    at_once = BOOSTERS_AT_ONCE if train.count() <= BOOSTED_ROWS_AT_ONCE else 1
    return OneVsRest(classifier=booster, featuresCol="features", labelCol="target", parallelism=at_once).fit(held)


def _perceptron(layers: Sequence[int], iterations: int) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="target", layers=list(layers), maxIter=iterations, blockSize=MLP_BLOCK, seed=SEED
    )


#: The model after so many more epochs, and its loss on the held-out rows.
Advance = Callable[[Model | None, int], tuple[Model, float]]


def _steps(train: DataFrame, held: DataFrame, layers: list[int]) -> Advance:
    loss = MulticlassClassificationEvaluator(labelCol="target", metricName="logLoss")

    def advance(model: Model | None, epochs: int) -> tuple[Model, float]:
        estimator = _perceptron(layers, epochs)
        if model is not None:
            estimator = estimator.setInitialWeights(model.weights)
        model = estimator.fit(train)
        return model, loss.evaluate(model.transform(held))

    return advance


def _steps_of_many(train: DataFrame, held: DataFrame, layers: list[int]) -> Advance:
    """The same epochs over the same rows by matrix products over blocks; Spark ML draws the first weights and makes the model."""
    rows, looked, one = perceptron.blocks(train), perceptron.blocks(held), materialize(train.limit(1), "perceptron-first")

    def advance(model: Model | None, epochs: int) -> tuple[Model, float]:
        start = model or _perceptron(layers, 0).fit(one)
        weights = perceptron.fitted(rows, start.weights.toArray(), layers, epochs)
        model = _perceptron(layers, 0).setInitialWeights(Vectors.dense(weights)).fit(one)
        return model, perceptron.log_loss(looked, weights, layers)

    return advance


def fit_perceptron_stopped(
    train: DataFrame,
    held: DataFrame,
    classes: int,
    epochs: int = MLP_EPOCHS,
    hidden: Sequence[int] = MLP_HIDDEN,
    step: int = MLP_STEP,
    patience: int = MLP_PATIENCE,
) -> tuple[Model, list[tuple[int, float]]]:
    """The perceptron with the lowest log loss on the held-out rows, and the loss after every step.

    Training goes on from the weights of the step before, ``step`` epochs at a time, and ends after ``patience``
    epochs without a new lowest loss, when a step changes nothing, or after ``epochs``. Only the weights, and beyond
    ``MLP_ROWS`` rows the gradients, pass through the driver. L-BFGS builds its search direction anew with each step, so steps of fewer than five epochs
    hardly train.
    """
    first = train.select("features").first()
    if first is None:
        raise ValueError("no rows to train on")
    layers = [first["features"].size, *hidden, classes]
    advance = _steps_of_many(train, held, layers) if train.count() > MLP_ROWS else _steps(train, held, layers)
    model, best, lowest, weak, losses = None, None, float("inf"), 0, []
    for done in range(0, epochs, step):
        before = model
        model, loss = advance(model, min(step, epochs - done))
        losses.append((min(done + step, epochs), loss))
        if losses[-1][1] < lowest:
            best, lowest, weak = model, losses[-1][1], 0
        else:
            weak += 1
        if weak * step >= patience or (before is not None and model.weights == before.weights):
            break
    # a loss that is never a number names no best step
    return best or model, losses


def fit_perceptron(
    train: DataFrame,
    classes: int,
    row_id: str | None = None,
    epochs: int = MLP_EPOCHS,
    hidden: Sequence[int] = MLP_HIDDEN,
    held_fraction: float = 0.1,
) -> Model:
    """With ``row_id``, a share of the rows is held out and training stops early on it; without, or where the
    share has no rows, all epochs run on all rows. Both shares are written once, as every step reads them again."""
    if row_id is not None:
        from flowtide.operators.sampling import with_split

        dealt = with_split(train, row_id, held_fraction, SEED + 1)
        held, rest = (materialize(dealt.where(share).drop("is_test"), "perceptron-share") for share in ("is_test", "NOT is_test"))
        if held.first() is not None and rest.first() is not None:
            return fit_perceptron_stopped(rest, held, classes, epochs, hidden)[0]
    width = train.select("features").first()["features"].size
    return _perceptron([width, *hidden, classes], epochs).fit(train)


def fit_perceptron_folds(
    train: DataFrame, row_id: str, classes: int, folds: int = MLP_FOLDS, epochs: int = MLP_EPOCHS, hidden: Sequence[int] = MLP_HIDDEN
) -> tuple[Model, float]:
    """A fresh perceptron per stratified fold, each stopped on its own held-out fold; the one with the lowest
    held-out loss of all, and that loss."""
    folded = materialize(stratified_folds(train, "target", row_id, folds), "perceptron-folds")
    found = []
    for fold in range(folds):
        rest, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        if held.first() is None:
            continue
        model, losses = fit_perceptron_stopped(rest, held, classes, epochs, hidden)
        found.append((min(loss for _, loss in losses), fold, model))
    loss, _, model = min(found, key=lambda one: one[:2])
    return model, loss


def predict(model: Model, df: DataFrame, out: str, probability: str | None = None) -> DataFrame:
    """Add the predicted code and, on request, the class probabilities as an array.

    One-vs-rest models only score classes, so their scores are passed through a softmax.
    """
    scored = model.transform(df)
    columns = {out: F.col("prediction").cast("int")}
    if probability:
        if "probability" in scored.columns:
            columns[probability] = vector_to_array("probability")
        else:
            columns[probability] = softmax(vector_to_array("rawPrediction"))
    return scored.withColumns(columns).select(*df.columns, *columns)


def predict_knn(
    df: DataFrame, references: DataFrame, row_id: str, out: str = "knn", k: int = 3, metric: str = "euclidean", p: float = 2.0
) -> DataFrame:
    """Predicted code of the nearest references, joined back by row id."""
    rows = df.select(F.col(row_id).alias("query_id"), vector_to_array("features").alias("embedding"))
    held = references.select(F.col(row_id).alias("reference_id"), vector_to_array("features").alias("embedding"), "target")
    voted = neighbour_vote(nearest(rows, held, k, metric, p=p), held, "target")
    answers = voted.select(F.col("query_id").alias(row_id), F.col("prediction").cast("int").alias(out))
    return df.join(answers, row_id, "left")


def knn_probabilities(neighbours: DataFrame, references: DataFrame, label: str, classes: int) -> DataFrame:
    """Share of each class among a query's neighbours, as an array in class order."""
    voted = neighbours.join(references.select("reference_id", label), "reference_id")
    shares = [F.avg((F.col(label) == c).cast("double")) for c in range(classes)]
    return voted.groupBy("query_id").agg(F.array(*shares).alias("probability"))


def fit_or_load(spark: SparkSession, path: str, fit: Callable[[], Model], load: Callable[[str], Model]) -> Model:
    """The saved model if there is one, else fit and save it."""
    if not path_exists(spark, f"{path}/metadata"):
        fit().write().overwrite().save(path)
    return load(path)


def random_grid(estimator: Estimator, space: dict[str, Sequence], trials: int, seed: int = SEED) -> list[dict]:
    """Seeded random points of a search space, all different: as many as asked for, or the whole space."""
    draw = random.Random(seed)
    points = []
    while len(points) < min(trials, math.prod(len(set(values)) for values in space.values())):
        point = {estimator.getParam(name): draw.choice(list(values)) for name, values in space.items()}
        if point not in points:
            points.append(point)
    return points


def evaluator(metric: str) -> MulticlassClassificationEvaluator:
    """Weighted F1, or balanced accuracy: accuracy under balanced class weights."""
    if metric == "balanced_accuracy":
        return MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy", weightCol="weight")
    return MulticlassClassificationEvaluator(labelCol="target", metricName=metric)


def search(
    train: DataFrame,
    row_id: str,
    metric: str,
    trials: int = BINARY_TRIALS,
    folds: int = BINARY_FOLDS,
    space: dict[str, Sequence] | None = None,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Random search with stratified folds; trials run side by side."""
    folded = stratified_folds(with_class_weights(train), "target", row_id, folds)
    estimator = forest()
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=random_grid(estimator, space or FOREST_SPACE, trials),
        evaluator=evaluator(metric),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=SEED,
    ).fit(folded)


def search_results(spark: SparkSession, fitted: CrossValidatorModel) -> DataFrame:
    """Trial number, mean score and parameters of a finished search."""
    rows = [
        (i, float(score), ", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda kv: kv[0].name)))
        for i, (score, point) in enumerate(zip(fitted.avgMetrics, fitted.getEstimatorParamMaps()))
    ]
    return spark.createDataFrame(rows, "trial int, score double, params string")


def search_knn(
    train: DataFrame, row_id: str, folds: int = KNN_FOLDS, trials: int = KNN_TRIALS, seed: int = SEED
) -> list[tuple[int, str, float]]:
    """(k, metric, mean weighted F1) of random points, best first. One neighbour search with the
    largest k per metric and fold serves every smaller k."""
    from flowtide.operators.metrics import weighted_metrics

    draw = random.Random(seed)
    points = sorted({(draw.choice(KNN_NEIGHBOURS), draw.choice(KNN_METRICS)) for _ in range(trials)})
    folded = stratified_folds(train, "target", row_id, folds).withColumn("embedding", vector_to_array("features"))
    scores: dict[tuple[int, str], list[float]] = {p: [] for p in points}
    for metric in sorted({m for _, m in points}):
        depths = [k for k, m in points if m == metric]
        for fold in range(folds):
            held = folded.where(F.col("fold") != fold).withColumnRenamed(row_id, "reference_id")
            asked = folded.where(F.col("fold") == fold).withColumnRenamed(row_id, "query_id")
            found = nearest(asked.select("query_id", "embedding"), held, max(depths), metric).cache()
            for k in depths:
                voted = neighbour_vote(found.where(F.col("rank") <= k), held, "target")
                paired = voted.join(asked.select("query_id", "target"), "query_id")
                scores[(k, metric)].append(weighted_metrics(paired, [], "target", "prediction").first()["f1"])
            found.unpersist()
    ranked = [(k, m, sum(s) / len(s)) for (k, m), s in scores.items()]
    return sorted(ranked, key=lambda r: (-r[2], r[0], r[1]))


def best_of_folds(
    train: DataFrame, row_id: str, folds: int, fit: Callable[[DataFrame], Model], metric: str = "f1"
) -> tuple[Model, float]:
    """Fit a fresh model per stratified fold and keep the one that scores best on its own
    held-out fold."""
    folded = stratified_folds(train, "target", row_id, folds)
    best: tuple[Model, float] | None = None
    for fold in range(folds):
        model = fit(folded.where(F.col("fold") != fold).drop("fold"))
        score = evaluator(metric).evaluate(model.transform(folded.where(F.col("fold") == fold)))
        if best is None or score > best[1]:
            best = (model, score)
    return best
