"""Models beat the majority class, survive saving, and the cascade documents every row."""

from __future__ import annotations

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from flowtide.operators import models
from flowtide.operators.metrics import weighted_metrics
from flowtide.plans import inference
from flowtide.plans.model_queries import EPOCHS, FOREST, ROUNDS, _flat, _prepared


@pytest.fixture(scope="module")
def prepared(spark, small):
    return _prepared(spark, small)


@pytest.fixture(scope="module")
def cascade(prepared):
    return inference.train_cascade(prepared, FOREST, ROUNDS, EPOCHS)


def accuracy(df, prediction):
    return weighted_metrics(df, [], "target", prediction).first()["accuracy"]


def test_voters_beat_the_majority_class(prepared, cascade):
    test = inference.labelled(prepared, prepared.test, "classification")
    counts = sorted(r["count"] for r in test.groupBy("target").count().collect())
    floor = counts[-1] / sum(counts)
    attacks = prepared.codes.encode(prepared.test.where("label <> 'Benign'"), "label", "target")
    voted = inference.classify(cascade, attacks)
    for name in ("rfc", "xgb", "mlp"):
        assert accuracy(voted, name) > floor + 0.1
    assert accuracy(voted, "knn") > floor
    train = inference.labelled(prepared, prepared.train, "classification")
    boosted = models.predict(models.fit_boosted(train, "flow_id", ROUNDS), test, "p").select("flow_id", "p")
    assert boosted.join(voted.select("flow_id", "xgb"), "flow_id").where("p <> xgb").count() == 0
    exact = models.predict_knn(test, train, "flow_id", "p")
    # the training rows are fewer than the bound, so the stage votes as the exact join does
    both = exact.select("flow_id", "p").join(voted.select("flow_id", "knn"), "flow_id")
    assert both.where("p <> knn").count() == 0 and both.count() == test.count()


def test_every_row_has_a_document(prepared, cascade):
    rows = _flat(inference.run_cascade(cascade, prepared.test)).collect()
    assert len({r["flow_id"] for r in rows}) == len(rows) == prepared.test.count()
    for r in rows:
        if r["pre_detection"] == "Benign":
            assert r["final_prediction"] == "Benign" and r["classifiers"] == "Pre-Detection=Benign"
        else:
            assert r["final_prediction"] in prepared.codes.classes
            assert r["classifiers"].count("=") == 5 + r["used_resolver"]


def test_probabilities_sum_to_one(prepared, cascade):
    test = inference.labelled(prepared, prepared.test, "classification")
    train = inference.labelled(prepared, prepared.train, "classification")
    fitted = [models.fit_forest(train, **FOREST), models.fit_boosted(train, "flow_id", 2), models.fit_perceptron(train, len(prepared.codes.classes), epochs=5)]
    for model in fitted:
        total = F.aggregate("pr", F.lit(0.0), lambda a, x: a + x)
        worst = models.predict(model, test, "p", "pr").select(F.max(F.abs(total - 1)).alias("w")).first()["w"]
        assert worst < 1e-6


def test_a_stored_cascade_answers_alike(spark, prepared, cascade, tmp_path):
    """Saved, loaded in a fresh session, applied to a table and to a stream: the same documents, without a join."""
    import io
    from contextlib import redirect_stdout

    from flowtide.streaming import streams

    cascade.save(spark, str(tmp_path / "cascade"))
    fresh = spark.newSession()
    loaded = inference.Cascade.load(fresh, str(tmp_path / "cascade"))
    prepared.test.write.parquet(str(tmp_path / "flows"))
    before = sorted(map(repr, _flat(inference.run_cascade(cascade, prepared.test)).collect()))
    scored = _flat(inference.run_cascade(loaded, fresh.read.parquet(str(tmp_path / "flows"))))
    assert sorted(map(repr, scored.collect())) == before
    plan = io.StringIO()
    with redirect_stdout(plan):
        scored.explain()
    assert "Join" not in plan.getvalue() and "Exchange" not in plan.getvalue()
    stream = spark.readStream.schema(prepared.test.schema).parquet(str(tmp_path / "flows"))
    streams.write_stream(_flat(inference.run_cascade(loaded, stream)), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).select(scored.columns).collect())) == before


def test_knn_search_prefers_the_better_setting(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.dense([float(i % 2) * 10 + (i % 7) * 0.1, 0.0]), i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, ["flow_id", "features", "target"])
    ranked = models.search_knn(train, "flow_id", folds=2, trials=3)
    assert ranked[0][2] == 1.0 and all(a[2] >= b[2] for a, b in zip(ranked, ranked[1:]))


@pytest.fixture(scope="module")
def noisy(spark):
    """Labels that follow one feature with many errors: a wide perceptron soon learns the errors."""
    import random

    from pyspark.ml.linalg import Vectors

    draw = random.Random(5)
    rows = []
    for i in range(240):
        x = [draw.gauss(0, 1) for _ in range(8)]
        rows.append((i, Vectors.dense(x), int((x[0] > 0) != (draw.random() < 0.35))))
    return spark.createDataFrame(rows, ["flow_id", "features", "target"]).coalesce(1).cache()


def test_perceptron_stops_on_held_out_loss(noisy):
    held, rest = noisy.where("flow_id % 3 = 0"), noisy.where("flow_id % 3 <> 0")
    model, losses = models.fit_perceptron_stopped(rest, held, 2, epochs=100, hidden=[24], step=5, patience=15)
    lowest = min(loss for _, loss in losses)
    at = [loss for _, loss in losses].index(lowest)
    assert losses[-1][0] < 100 and len(losses) - 1 - at == 3
    # the weights of the best step are kept, not the last ones
    assert MulticlassClassificationEvaluator(labelCol="target", metricName="logLoss").evaluate(model.transform(held)) == pytest.approx(lowest)
    assert losses[-1][1] > lowest


def test_perceptron_goes_on_from_the_step_before(noisy):
    """Steps add up: after the last one the loss on the training rows is below that of the first."""
    _, losses = models.fit_perceptron_stopped(noisy, noisy, 2, epochs=30, hidden=[16], step=10)
    assert [e for e, _ in losses] == [10, 20, 30] and losses[-1][1] < losses[0][1]


def test_best_perceptron_of_folds(noisy):
    model, loss = models.fit_perceptron_folds(noisy, "flow_id", 2, folds=2, epochs=4, hidden=[4])
    assert 0 < loss < 1 and model.transform(noisy).count() == 240


def test_random_points_differ_and_are_as_many_as_asked_for():
    from pyspark.ml.classification import RandomForestClassifier

    space = {"numTrees": [1, 2], "maxDepth": [3, 4]}
    for trials, many in ((3, 3), (4, 4), (9, 4)):
        points = models.random_grid(RandomForestClassifier(), space, trials)
        assert len(points) == many and len({tuple(p[k] for k in sorted(p, key=lambda k: k.name)) for p in points}) == many


def test_many_rows_are_dealt_over_tasks(spark):
    """One block of a file would be one task, whatever its rows."""
    from flowtide.session import ROWS_A_TASK, spread

    many = spark.range(4 * ROWS_A_TASK + 1).coalesce(1)
    dealt = spread(many)
    assert dealt.rdd.getNumPartitions() == 5 and dealt.distinct().count() == 4 * ROWS_A_TASK + 1
    assert spread(many.limit(50).coalesce(1)).rdd.getNumPartitions() == 1


def test_the_neighbour_stage_ranks_as_all_distances_do():
    import numpy as np

    from flowtide.operators.neighbors import distances
    from flowtide.operators.stages import _ranked_places

    draw = np.random.default_rng(3)
    rows, references = draw.normal(size=(40, 4)).round(), draw.normal(size=(300, 4)).round()
    rows[::5, 0], references[::3, 1] = np.nan, np.nan
    for known in (references, references[:4]):  # of four, two have no distance
        with np.errstate(invalid="ignore"):
            want = np.argsort(distances(rows, known, "euclidean"), axis=1, kind="stable")[:, :3]
        assert (_ranked_places(rows, known, 3, "euclidean") == want).all()


def test_perceptron_works_out_its_rows_once(spark, noisy):
    """However many steps there are, the rows handed over are computed for writing both shares, and no more."""
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    counting = F.udf(counted, "long").asNondeterministic()
    rows = noisy.select(counting("flow_id").alias("flow_id"), "features", "target")
    models.fit_perceptron(rows, 2, "flow_id", epochs=20, hidden=[4])
    assert 0 < seen.value <= 4 * 240


def test_boosters_of_many_rows_are_fitted_one_after_the_other(noisy, monkeypatch):
    """Side by side each would hold all rows in memory; the models are the same."""
    used = []

    class Seen(models.OneVsRest):
        def fit(self, rows):
            used.append(self.getParallelism())
            return super().fit(rows)

    monkeypatch.setattr(models, "OneVsRest", Seen)
    together = models.fit_boosted(noisy, "flow_id", 2)
    monkeypatch.setattr(models, "BOOSTED_ROWS_AT_ONCE", 100, raising=False)
    apart = models.fit_boosted(noisy, "flow_id", 2)
    assert used == [4, 1]
    for one, other in zip(apart.models, together.models, strict=True):
        trees = [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in (one, other)]
        assert trees[0] == trees[1] and one.treeWeights == other.treeWeights


def _references(spark, n, seed=11):
    """Rows on a coarse grid, so that many are equally near, with ids that come twice and numbers that are not."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    draw = np.random.default_rng(seed)
    points = draw.integers(-3, 4, (n, 3)).astype(float)
    points[::17, 1], points[5::29, 0] = np.nan, np.inf
    rows = [(int(i) // 2 if i % 10 == 1 else int(i), Vectors.dense(p), int(c)) for i, p, c in zip(draw.permutation(n), points, draw.integers(0, 3, n))]
    return spark.createDataFrame(rows, ["flow_id", "features", "target"])


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_references_in_a_table_vote_as_held_ones_do(spark, tmp_path, monkeypatch, metric):
    """Beyond the number that tasks hold, the votes stay those of all references: ties, copies, rows without a distance."""
    from flowtide.operators import stages

    references = _references(spark, 400)
    asked = _references(spark, 150, 12).select("features", (F.col("target") > 0).alias("ask")).withColumn("n", F.monotonically_increasing_id())
    for when in ("", "ask"):
        held = stages.NeighbourStage(3, metric, "features", "vote", when).remember(references, "flow_id")
        monkeypatch.setattr(stages, "MAX_REFERENCES", 50)
        listed = stages.NeighbourStage(3, metric, "features", "vote", when).remember(references, "flow_id")
        assert held.table is None and listed.table is not None
        want = sorted((r["n"], r["vote"]) for r in held.transform(asked).collect())
        assert sorted((r["n"], r["vote"]) for r in listed.transform(asked).collect()) == want
        listed.write().overwrite().save(str(tmp_path / metric))
        again = stages.NeighbourStage.load(str(tmp_path / metric))
        assert again.table is not None and sorted((r["n"], r["vote"]) for r in again.transform(asked).collect()) == want
        assert listed.transform(asked).columns == held.transform(asked).columns
        monkeypatch.undo()


def test_no_reference_is_left_out(spark):
    """More references than a stage once held: every one finds itself."""
    from flowtide.operators.stages import NeighbourStage
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(21_000).select(
        F.col("id").alias("flow_id"), array_to_vector(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("features"), (F.col("id") % 7).cast("int").alias("target"))
    stage = NeighbourStage(1).remember(rows, "flow_id")
    assert len(stage.labels) == 21_000
    assert stage.transform(rows.where("flow_id % 3 = 0")).where("knn <> target").count() == 0


def test_a_cascade_of_many_references_answers_alike_in_all_queries(spark, tmp_path, monkeypatch):
    """With the references in a table: the same documents as with held ones, from the table and from the stream, which
    leaves no other table than its answers."""
    import os

    from flowtide.operators import stages
    from flowtide.plans import model_queries
    from flowtide.session import shared_folder

    kind = F.element_at(F.array(*[F.lit(x) for x in ("view", "error", "signup", "purchase", "click")]), (F.col("id") % 5 + 1).cast("int"))
    events = spark.range(1500).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") * 7 % 90).alias("user_id"), kind.alias("event_type"),
        F.round(F.pmod(F.xxhash64("id"), F.lit(997)) / 10.0, 1).alias("value"), F.concat(F.lit('{"k": '), F.pmod(F.xxhash64("id"), F.lit(50)).cast("string"), F.lit("}")).alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for name, value in (("FOREST", {"numTrees": 3, "maxDepth": 3}), ("ROUNDS", 1), ("EPOCHS", 5)):
        monkeypatch.setattr(model_queries, name, value)

    def answers(df):
        return sorted(map(repr, df.select(sorted(df.columns)).collect()))

    held = answers(model_queries.cascade(spark, str(tmp_path)))
    monkeypatch.setattr(stages, "MAX_REFERENCES", 300)
    fits, whole = [], model_queries._cascade
    monkeypatch.setattr(model_queries, "_cascade", lambda *a: fits[0] if fits else fits.append(whole(*a)) or fits[0])
    assert answers(model_queries.cascade(spark, str(tmp_path))) == held
    assert fits[0][1].classifier.stages[-1].table is not None and fits[0][1].memory.table is not None
    before = {x for x in os.listdir(shared_folder(spark)) if x.startswith(("asked", "votes", "visits", "voted"))}
    assert answers(model_queries.stream_cascade(spark, str(tmp_path))) == held
    assert {x for x in os.listdir(shared_folder(spark)) if x.startswith(("asked", "votes", "visits", "voted"))} == before


def test_the_perceptron_of_many_rows_has_the_loss_and_gradient_of_spark(spark, noisy):
    """The weights are laid out as Spark has them, the loss is its evaluator's, the gradient that of the loss."""
    import numpy as np

    from flowtide.operators import perceptron

    model = models._perceptron([8, 5, 4, 2], 3).fit(noisy)
    weights, layers, table = model.weights.toArray(), [8, 5, 4, 2], perceptron.blocks(noisy)
    spark_loss = MulticlassClassificationEvaluator(labelCol="target", metricName="logLoss").evaluate(model.transform(noisy))
    loss, gradient = perceptron.mean_loss(table, weights, layers)
    assert loss == pytest.approx(spark_loss, rel=1e-5) and perceptron.log_loss(table, weights, layers) == pytest.approx(spark_loss, rel=1e-5)
    x = np.random.default_rng(2).normal(size=(50, 8))
    y = (x[:, 0] > 0).astype(int)
    exact = perceptron.loss_and_gradient(x, y, weights, layers)[1]
    for i in range(0, len(weights), 7):
        moved = np.zeros(len(weights))
        moved[i] = 1e-5
        up, down = (perceptron.loss_and_gradient(x, y, weights + m, layers)[0] for m in (moved, -moved))
        assert (up - down) / 2e-5 == pytest.approx(exact[i], rel=1e-4, abs=1e-6)


def test_the_perceptron_of_many_rows_trains_as_spark_does(noisy, monkeypatch):
    """The same first weights, epochs and stopping rule; the loss after the last step is no worse than that of Spark ML."""
    _, want = models.fit_perceptron_stopped(noisy, noisy, 2, epochs=15, hidden=[6])
    monkeypatch.setattr(models, "MLP_ROWS", 100)
    seen, whole = [], models.perceptron.mean_loss
    monkeypatch.setattr(models.perceptron, "mean_loss", lambda *a: seen.append(whole(*a)) or seen[-1])
    model, got = models.fit_perceptron_stopped(noisy, noisy, 2, epochs=15, hidden=[6])
    assert [e for e, _ in got] == [e for e, _ in want] and len(seen) >= 15
    assert got[-1][1] <= 1.05 * want[-1][1] and got[-1][1] < got[0][1]
    lowest = MulticlassClassificationEvaluator(labelCol="target", metricName="logLoss").evaluate(model.transform(noisy))
    assert lowest == pytest.approx(min(loss for _, loss in got), rel=1e-4)


def test_the_perceptron_of_many_rows_refuses_what_spark_refuses(spark, noisy):
    """Rows with a number that is not one would leave it untrained without a word."""
    from pyspark.errors import PythonException
    from pyspark.ml.linalg import Vectors

    from flowtide.operators import perceptron

    odd = spark.createDataFrame([(1, Vectors.dense([float("nan")] * 8), 0)], ["flow_id", "features", "target"])
    with pytest.raises(PythonException, match="finite"):
        perceptron.blocks(noisy.unionByName(odd))
