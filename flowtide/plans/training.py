"""The training-side composition: clean, engineer, split, encode."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.operators.encoding import FlowEncoder, LabelCodes
from flowtide.operators.sampling import train_test_split

BENIGN = "Benign"


@dataclass
class Prepared:
    """Original splits, one fitted encoder per stage, and the attack class codes."""

    train: DataFrame
    test: DataFrame
    label: str
    row_id: str
    detection: FlowEncoder
    classification: FlowEncoder
    codes: LabelCodes

    def detection_rows(self, df: DataFrame) -> DataFrame:
        """Rows encoded for the binary stage, target 0 benign / 1 malicious."""
        target = F.when(F.col(self.label) == BENIGN, 0).otherwise(1)
        return self.detection.transform(df.withColumn("target", target))

    def classification_rows(self, df: DataFrame) -> DataFrame:
        """Malicious rows encoded for the attack-class stage, target the class code."""
        malicious = df.where(F.col(self.label) != BENIGN)
        return self.classification.transform(self.codes.encode(malicious, self.label, "target"))

    def encoded(self) -> DataFrame:
        """Both stages and both splits in one long table."""
        parts = [
            rows(df).withColumns({"stage": F.lit(stage), "is_test": F.lit(is_test)})
            for stage, rows in (("pre_detection", self.detection_rows), ("post_classification", self.classification_rows))
            for is_test, df in ((False, self.train), (True, self.test))
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out


def transform_data(
    df: DataFrame,
    label: str,
    row_id: str,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    test_fraction: float = 0.2,
) -> Prepared:
    """Split 80/20 and fit one encoder per stage on that stage's own training rows."""
    train, test = train_test_split(df, row_id, test_fraction)
    features = df.drop(label, row_id)
    if numeric is None:
        numeric = [c for c, kind in features.dtypes if kind != "string"]
    if categorical is None:
        categorical = [c for c, kind in features.dtypes if kind == "string"]
    malicious = train.where(F.col(label) != BENIGN)
    return Prepared(
        train,
        test,
        label,
        row_id,
        FlowEncoder.fit(train, numeric, categorical),
        FlowEncoder.fit(malicious, numeric, categorical),
        LabelCodes.fit(malicious, label),
    )
