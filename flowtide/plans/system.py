"""End to end: from raw flow records to a trained cascade, and from live flows to rules.

Everything that is kept (datasets, encoders, metrics, models, memory, rules, report) is a table
or a saved model under one base folder, which every executor must be able to reach.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.operators import cleaning, live, metrics, retrieval, rules, sampling, voting
from flowtide.operators.features import engineer_features
from flowtide.operators.profile import dataset_profile
from flowtide.plans import inference, report
from flowtide.plans.training import BENIGN, Prepared, transform_data
from flowtide.session import materialize
from flowtide.sources import files

# Label column and the share of the records used for training.
LABEL = "label"
TRAINING_SHARE = 0.05
NUMBERS = ["flow_duration", "flow_bytes_s", "flow_packets_s"]
RAW_FEATURES = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "ts", *NUMBERS]


@dataclass
class FlowSystem:
    spark: SparkSession
    base: str
    window: str = "1s"
    row_id: str = "flow_id"
    # Addresses identify hosts and have no bounded dictionary, so they are carried along but not encoded.
    carried: list[str] = field(default_factory=lambda: ["src_ip", "dst_ip"])

    def load_csv(self, path: str) -> DataFrame:
        """Raw records with an id, written once: equal records have different ids, and the same on every read.
        Rows that do not fit the schema are stored apart."""
        flows = files.normalise_flows(files.scan_flow_csv(self.spark, path, f"{self.base}/bad_rows"))
        return materialize(flows.withColumn(self.row_id, F.monotonically_increasing_id()), "records")

    def preprocess_training(self, flows: DataFrame, share: float = TRAINING_SHARE, min_score: float = 0.0) -> DataFrame:
        """Sample, prune, clean, engineer and select features; profiles before and after are stored."""
        sampled = sampling.hash_sample(flows, self.row_id, share)
        kept = cleaning.keep_selected_features(sampled, [self.row_id, *RAW_FEATURES], LABEL)
        files.write_metrics(dataset_profile(kept), f"{self.base}/profile_before")
        cleaned = cleaning.clean_data(cleaning.clean_numeric(kept, NUMBERS), LABEL)
        featured = materialize(engineer_features(cleaned, self.window, self.window), "featured")
        target = featured.withColumn("__target", F.when(F.col(LABEL) == BENIGN, 0).otherwise(1))
        scored = [c for c, kind in featured.dtypes if kind != "string" and c != self.row_id]
        chosen = retrieval.select_features(target, scored, "__target", min_score).drop("__target")
        files.write_metrics(dataset_profile(chosen), f"{self.base}/profile_after")
        return chosen

    def prepare(self, chosen: DataFrame) -> Prepared:
        """Split and fit encoders; the original and encoded splits of both stages are stored."""
        features = chosen.drop(*self.carried)
        prepared = transform_data(features, LABEL, self.row_id)
        for name, part in {"train_original": prepared.train, "test_original": prepared.test}.items():
            files.save_dataset(part, self.base, name)
            files.save_dataset(prepared.detection_rows(part), self.base, name.replace("original", "pre_detection"))
            files.save_dataset(prepared.classification_rows(part), self.base, name.replace("original", "post_classification"))
        prepared.detection.save(self.spark, f"{self.base}/encoder_detection")
        prepared.classification.save(self.spark, f"{self.base}/encoder_classification")
        return prepared

    def train(self, prepared: Prepared, **settings) -> inference.Cascade:
        """Fit the cascade and store it whole, with its test metrics. The rows of the test split that were answered
        correctly are remembered: with the training rows they settle later ties."""
        cascade = inference.train_cascade(prepared, **settings)
        target = F.when(F.col(LABEL) == BENIGN, 0).otherwise(1).alias("target")
        found = materialize(
            inference.detect(cascade, prepared.test).select(self.row_id, target, F.col("is_malicious").cast("int").alias("prediction")), "detected")
        files.write_metrics(metrics.binary_metrics(found, "target", "prediction"), f"{self.base}/metrics/binary")
        attacks = prepared.codes.encode(prepared.test.where(F.col(LABEL) != BENIGN), LABEL, "truth")
        voted = materialize(inference.classify(cascade, attacks), "classified")
        long = metrics.voters_long(voted, [*voting.VOTERS, "majority"], [self.row_id, "truth"])
        files.write_metrics(metrics.weighted_metrics(long, ["classifier"], "truth", "prediction"), f"{self.base}/metrics/voters")
        files.write_metrics(metrics.confusion_matrix(voted, "truth", "majority"), f"{self.base}/metrics/confusion")
        answered = voted.select(self.row_id, F.col("final_code").alias("prediction"))
        memory = retrieval.memory_candidates(answered, voted.select(self.row_id, "truth"), self.row_id, "truth")
        files.save_dataset(memory, self.base, "memory")
        remembered = cascade.vectors(attacks).join(memory.select(self.row_id), self.row_id).select(self.row_id, "features", F.col("truth").alias("target"))
        training = inference.labelled(prepared, prepared.train, "classification").select(self.row_id, "features", "target")
        cascade.memory.remember(remembered.unionByName(training), self.row_id)
        cascade.save(self.spark, f"{self.base}/cascade")
        return cascade

    def load(self) -> inference.Cascade:
        """The stored cascade, as it was trained."""
        return inference.Cascade.load(self.spark, f"{self.base}/cascade")

    def featured(self, flows: DataFrame) -> DataFrame:
        """Live or recorded flows to the columns the encoders expect."""
        return engineer_features(cleaning.clean_numeric(flows, NUMBERS), self.window, self.window)

    def infer(self, cascade: inference.Cascade, flows: DataFrame) -> DataFrame:
        """Result documents of flows, by row id. The features are computed once and written,
        as both stages of the cascade read them."""
        return inference.run_cascade(cascade, materialize(self.featured(flows).drop(LABEL), "live-features"))

    def mitigate(self, flows: DataFrame, results: DataFrame, dpid: int = 2, store: bool = True) -> DataFrame:
        """Rules of the flows found malicious; stored once each unless told otherwise."""
        answered = flows.join(results.select(self.row_id, F.col("result.final_prediction").alias("prediction")), self.row_id)
        made = rules.rules_from_predictions(answered, [self.row_id], "prediction", dpid)
        if store:
            live.append_rules(made, f"{self.base}/rules")
        return made

    def write_report(self, flows: DataFrame, results: DataFrame) -> None:
        rows = flows.join(results, self.row_id)
        shown = voting.report_majority(F.col("result"))["prediction"]
        report.write_report(
            report.report_rows(rows, self.row_id, F.col("result.final_prediction"), shown), f"{self.base}/report"
        )
