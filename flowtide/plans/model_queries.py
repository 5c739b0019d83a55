"""Named queries that fit and apply models. Results depend on Spark's training, so they have no
checking SQL; tests compare their quality with the majority class."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions.vectors import argmax
from flowtide.operators import encoding, live, models, voting
from flowtide.operators.features import add_categories
from flowtide.plans import inference
from flowtide.plans.registry import query
from flowtide.session import fresh_path, materialize, spread
from flowtide.sources import adapters
from flowtide.streaming import streams

NUMERIC = ["flow_duration", "flow_bytes_s", "dst_port"]
CATEGORICAL = ["DstPortCategory", "ProtocolCategory"]
# Small settings that keep the named queries quick; the operators' defaults are the full ones.
FOREST = {"numTrees": 20, "maxDepth": 6}
ROUNDS = 5
EPOCHS = 30


def _prepared(spark, folder):
    flows = add_categories(adapters.flows(spark, folder)).select("flow_id", "label", *NUMERIC, *CATEGORICAL)
    return inference.prepare(flows, "label", "flow_id", NUMERIC, CATEGORICAL)


def _stage(spark, folder, stage):
    prepared = _prepared(spark, folder)
    train = materialize(spread(inference.labelled(prepared, prepared.train, stage)), f"train-{stage}")
    return prepared, train, inference.labelled(prepared, spread(prepared.test), stage)


@query("rf_binary")
def rf_binary(spark, folder):
    _, train, test = _stage(spark, folder, "detection")
    return models.predict(models.fit_forest(train, **FOREST), test, "prediction").drop("features")


@query("malicious_predicted")
def malicious_predicted(spark, folder):
    """Flows the detector calls malicious, with their original columns in the same row."""
    prepared, train, test = _stage(spark, folder, "detection")
    found = models.predict(models.fit_forest(train, **FOREST), test, "prediction").where(F.col("prediction") == 1)
    return prepared.test.join(found.select("flow_id"), "flow_id")


@query("rf_multi")
def rf_multi(spark, folder):
    _, train, test = _stage(spark, folder, "classification")
    return models.predict(models.fit_forest(train, **FOREST), test, "prediction").drop("features")


@query("gbt_multi")
def gbt_multi(spark, folder):
    _, train, test = _stage(spark, folder, "classification")
    scored = models.predict(models.fit_boosted(train, "flow_id", ROUNDS), test, "prediction", "probability")
    return scored.select("flow_id", "target", "prediction", argmax(F.col("probability")).alias("most_probable"))


@query("mlp_multi")
def mlp_multi(spark, folder):
    prepared, train, test = _stage(spark, folder, "classification")
    model = models.fit_perceptron(train, len(prepared.codes.classes), "flow_id")
    return models.predict(model, test, "prediction").drop("features")


@query("knn_multi")
def knn_multi(spark, folder):
    _, train, test = _stage(spark, folder, "classification")
    return models.predict_knn(test, train, "flow_id", "prediction").drop("features")


@query("param_search")
def param_search(spark, folder):
    """A small seeded search over the forest's space, stratified folds, balanced accuracy."""
    _, train, _ = _stage(spark, folder, "detection")
    space = {"numTrees": [5, 10], "maxDepth": [3, 5], "featureSubsetStrategy": ["sqrt", "log2"]}
    fitted = models.search(train, "flow_id", "balanced_accuracy", trials=3, folds=2, space=space)
    return models.search_results(spark, fitted)


@query("model_roundtrip")
def model_roundtrip(spark, folder):
    """Fitted once, saved, loaded: both copies must predict the same."""
    from pyspark.ml.classification import RandomForestClassificationModel

    prepared, train, test = _stage(spark, folder, "detection")
    path = fresh_path(spark, "forest")
    fitted = models.fit_forest(train, **FOREST)
    models.fit_or_load(spark, path, lambda: fitted, RandomForestClassificationModel.load)
    loaded = models.fit_or_load(spark, path, lambda: fitted, RandomForestClassificationModel.load)
    encoder_path = fresh_path(spark, "encoder")
    prepared.detection.save(spark, encoder_path)
    same_encoder = encoding.FlowEncoder.load(spark, encoder_path).feature_names() == prepared.detection.feature_names()
    both = models.predict(loaded, models.predict(fitted, test, "before"), "after")
    return both.select("flow_id", "before", "after", F.lit(same_encoder).alias("same_encoder"))


def _cascade(spark, folder):
    prepared = _prepared(spark, folder)
    return prepared, inference.train_cascade(prepared, FOREST, ROUNDS, EPOCHS)


def _flat(documents):
    result = F.col("result")
    return documents.select(
        "flow_id",
        result["pre_detection"]["prediction"].alias("pre_detection"),
        F.array_join(F.transform(voting.classifier_list(result), lambda v: F.concat(v["name"], F.lit("="), v["prediction"])), ";").alias("classifiers"),
        voting.report_majority(result)["agreement_ratio"].alias("agreement_ratio"),
        result["final_prediction"].alias("final_prediction"),
        result["used_llm"].alias("used_resolver"),
    )


@query("cascade")
def cascade(spark, folder):
    """Detector, four voters, tie resolution: one document per test flow."""
    prepared, fitted = _cascade(spark, folder)
    return _flat(inference.run_cascade(fitted, spread(prepared.test)))


@query("mitigation_from_cascade")
def mitigation_from_cascade(spark, folder):
    """Classified test flows to rules, stored once, with their status (nothing is executed)."""
    from flowtide.operators import rules

    prepared, fitted = _cascade(spark, folder)
    results = _flat(inference.run_cascade(fitted, spread(prepared.test))).select("flow_id", "final_prediction")
    flows = adapters.flows(spark, folder).join(results, "flow_id")
    made = rules.rules_from_predictions(flows, ["flow_id"], "final_prediction", dpid=2)
    path = fresh_path(spark, "cascade-rules")
    live.append_rules(made, path)
    stored = spark.read.parquet(path)
    return stored.select("command_type", "description", "priority", "rule_json", F.lit("generated").alias("status"))


@query("stream_cascade")
def stream_cascade(spark, folder):
    """A stored cascade, loaded and applied to streamed test flows: no batch leaves more than its answers."""
    prepared, fitted = _cascade(spark, folder)
    path = fresh_path(spark, "stored-cascade")
    fitted.save(spark, path)
    loaded = inference.Cascade.load(spark, path)
    landing, out = fresh_path(spark, "test-landing"), fresh_path(spark, "streamed-results")
    spread(prepared.test).write.parquet(landing)
    stream = spark.readStream.schema(prepared.test.schema).parquet(landing)
    answer = streams.score_batches(lambda rows: _flat(inference.run_cascade(loaded, rows)), out)
    streams.each_batch(stream, answer, fresh_path(spark, "streamed-log")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("feature_vectors")
def feature_vectors(spark, folder):
    """Addresses hashed instead of one-hot encoded: no dictionary however many there are."""
    flows = adapters.flows(spark, folder)
    fitted = encoding.vector_stage(["flow_duration", "dst_port"], ["src_ip", "dst_ip"], 1 << 12).fit(flows)
    from pyspark.ml.functions import vector_to_array

    vectors = fitted.transform(flows).select("flow_id", vector_to_array("features").alias("v"))
    return vectors.select("flow_id", F.size("v").alias("width"), F.size(F.filter("v", lambda x: x != 0)).alias("filled"))
