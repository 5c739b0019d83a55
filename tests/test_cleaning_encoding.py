from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowtide.operators import cleaning, metrics
from flowtide.operators.encoding import FlowEncoder, LabelCodes, vector_stage
from flowtide.sources import files

INF, NAN = float("inf"), float("nan")


def test_clean_data_in_order(spark):
    rows = [("a", float(i), 1) for i in range(10)] + [("a", 3.0, 1)]  # a duplicate
    rows += [("b", float(i), 1) for i in range(9)]  # one row short
    rows += [("a", INF, 1), ("a", NAN, 1), ("a", None, 1), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "label string, x double, same int")
    out = cleaning.clean_data(df, "label", 10)
    assert out.columns == ["label", "x"]
    assert sorted(r["x"] for r in out.collect()) == [float(i) for i in range(10)]
    assert {r["label"] for r in out.collect()} == {"a"}


def test_constant_label_is_kept(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(12)], "label string, x double")
    assert cleaning.clean_data(df, "label").columns == ["label", "x"]


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([("nine", i) for i in range(9)] + [("ten", i) for i in range(10)], "label string, x int")
    assert {r["label"] for r in cleaning.drop_rare_classes(df, "label").collect()} == {"ten"}


def test_all_null_column_is_not_constant(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 5)], "a int, b string, c int")
    assert cleaning.constant_columns(df) == ["c"]


def test_clean_numeric(spark):
    df = spark.createDataFrame([("'3",), ("4,0",), ("1,234.5",), ("x",), (None,)], "v string")
    assert [r["v"] for r in cleaning.clean_numeric(df, ["v"]).collect()] == [3.0, 40.0, 1234.5, None, None]


def test_drop_is_all_or_nothing(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert cleaning.drop_irrelevant_features(df, " a, c ").columns == ["b"]
    with pytest.raises(ValueError, match="nope"):
        cleaning.drop_irrelevant_features(df, "a, nope")
    with pytest.raises(ValueError, match="z"):
        cleaning.align_schema(df, ["a", "z"])


def test_csv_bad_rows_are_kept_aside(spark, tmp_path):
    path = tmp_path / "flows.csv"
    head = "Src IP,Src Port,Dst IP,Dst Port,Protocol,Timestamp,Flow Duration,Flow Bytes/s,Flow Packets/s,Label"
    path.write_text(f"{head}\n10.0.0.1,1,10.0.0.2,80,6,11/10/2023 01:02:03 PM,5,1.5,2.5,Benign\n10.0.0.1,x,10.0.0.2,80,6,,5,1,2,Benign\n")
    good = files.normalise_flows(files.scan_flow_csv(spark, str(path))).collect()
    assert len(good) == 1 and (good[0]["ts"].month, good[0]["ts"].day, good[0]["dst_port"]) == (10, 11, 80)
    kept = files.scan_flow_csv(spark, str(path), str(tmp_path / "bad"))
    assert kept.select("Src IP").count() == 1 and kept.count() == 1  # whatever is read
    assert [r["value"] for r in spark.read.text(str(tmp_path / "bad")).collect()] == ["10.0.0.1,x,10.0.0.2,80,6,,5,1,2,Benign"]


def test_load_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.load_or_build(spark, str(tmp_path), "x", build).count() == 3
    assert len(calls) == 1


def test_encoder(spark, tmp_path):
    train = spark.createDataFrame([("x", 1.0, 7.0), ("y", 3.0, 7.0)], "c string, n double, z double")
    encoder = FlowEncoder.fit(train)
    assert encoder.feature_names() == ["c_x", "c_y", "n", "z"]
    encoder.save(spark, str(tmp_path / "e"))
    loaded = FlowEncoder.load(spark, str(tmp_path / "e"))
    unseen = spark.createDataFrame([("new", 2.0, 8.0), (None, 1.0, 7.0)], "c string, n double, z double")
    # Population deviation 1; a constant column is only centred; unseen and null are all zeros.
    assert [tuple(r) for r in loaded.transform(unseen).collect()] == [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, -1.0, 0.0)]


def test_too_many_categories(spark):
    from flowtide.operators.encoding import distinct_sorted

    with pytest.raises(ValueError):
        distinct_sorted(spark.range(20), "id", limit=10)


def test_hashed_vectors(spark):
    df = spark.createDataFrame([("10.0.0.1", 1.0), ("10.0.0.2", 2.0)], "ip string, n double")
    row = vector_stage(["n"], ["ip"], 64).fit(df).transform(df).first()
    assert row["features"].size == 65


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "label string")
    codes = LabelCodes.fit(df, "label")
    got = codes.decode(codes.encode(df, "label"), "label_code", "back").collect()
    assert [(r["label_code"], r["back"]) for r in got] == [(1, "b"), (0, "a"), (2, "c")]
    with pytest.raises(Exception, match="not seen in training"):
        codes.encode(spark.createDataFrame([("d",)], "label string"), "label").collect()


def test_metrics_without_predictions_of_the_class(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "t int, p int")
    assert tuple(metrics.binary_metrics(df, "t", "p").first()) == (0.5, 0.0, 0.0, 0.0)


def test_confusion_is_filled(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b")], "t string, p string")
    got = {(r["truth"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(df, "t", "p").collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 2, ("b", "a"): 0, ("b", "b"): 0}


def test_pr_curve_of_a_class_without_positives(spark):
    df = spark.createDataFrame([(0, 0.5, 0), (0, 0.7, 0)], "c int, s double, y int")
    got = [(r["precision"], r["recall"]) for r in metrics.pr_curve(df, "c", "s", "y").collect()]
    assert sorted(got) == [(0.0, 1.0), (0.0, 1.0), (1.0, 0.0)]
