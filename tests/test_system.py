"""The whole way, once: raw CSV to trained cascade, recorded flows to stored rules and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.operators.live import reset_rules
from flowtide.operators.models import best_of_folds, fit_forest
from flowtide.plans import inference, report
from flowtide.plans.system import FlowSystem
from flowtide.schemas import FLOW_COLUMNS, FLOW_SCHEMA
from flowtide.sources import adapters, files


def test_end_to_end(spark, small, tmp_path):
    raw = adapters.flows(spark, small).select(
        *[F.col(own).cast(FLOW_SCHEMA[name].dataType).alias(name) for name, own in FLOW_COLUMNS.items()]
    )
    files.write_csv(raw.unionByName(raw.limit(20)), str(tmp_path / "csv"))  # some records come twice
    system = FlowSystem(spark, str(tmp_path / "base"), window="1day")
    flows = system.load_csv(str(tmp_path / "csv"))
    chosen = system.preprocess_training(flows, share=1.0)
    assert {"Entropy_DstPorts_per_SrcIP_1day", "ProtocolCategory", "src_ip"} <= set(chosen.columns)
    assert "ts" not in chosen.columns and "dst_port" not in chosen.columns
    prepared = system.prepare(chosen)
    cascade = system.train(prepared, forest_params={"numTrees": 10, "maxDepth": 5}, boosting_rounds=3, epochs=10)
    voters = {r["classifier"]: r["f1"] for r in spark.read.json(f"{system.base}/metrics/voters").collect()}
    assert set(voters) == {"rfc", "xgb", "mlp", "knn", "majority"} and voters["rfc"] > 0.4
    assert files.load_dataset(spark, system.base, "train_pre_detection").count() == prepared.train.count()

    stored = system.load()
    assert stored.classes == cascade.classes and len(stored.memory.labels) == len(cascade.memory.labels) > 0
    results = system.infer(stored, flows.drop("label"))
    results.write.parquet(str(tmp_path / "results"))
    results = spark.read.parquet(str(tmp_path / "results"))
    assert results.count() == flows.count()
    made = system.mitigate(flows, results)
    assert made.count() == results.where(F.col("result.final_prediction") != "Benign").count()
    system.mitigate(flows, results)
    stored = spark.read.parquet(f"{system.base}/rules")
    assert stored.count() == made.select("command_type", "priority", "rule_json").distinct().count()
    reset_rules(spark, f"{system.base}/rules", stored.schema)
    assert spark.read.parquet(f"{system.base}/rules").count() == 0
    system.write_report(flows, results)
    assert report.read_report(spark, f"{system.base}/report").count() == flows.count()

    rows = inference.labelled(prepared, prepared.train, "classification")
    model, score = best_of_folds(rows, "flow_id", 2, lambda train: fit_forest(train, numTrees=5, maxDepth=4))
    assert 0 < score <= 1 and model.getNumTrees == 5
