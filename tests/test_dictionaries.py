"""Dictionaries of any size: codes, vectors, saving, and plans without a branch per category."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from flowtide.operators.dictionaries import Dictionary, SparseEncoder
from flowtide.operators.encoding import FlowEncoder

MANY = 100_000


@pytest.fixture(scope="module")
def wide(spark):
    """100,000 addresses, of which one has a third of the rows."""
    return spark.range(3 * MANY // 2).select(
        "id", F.when(F.col("id") >= MANY, F.lit("a7")).otherwise(F.concat(F.lit("a"), F.col("id"))).alias("ip"),
        F.when(F.col("id") % 3 == 0, "tcp").when(F.col("id") % 3 == 1, "udp").alias("kind"), (F.col("id") % 11).alias("n"))


@pytest.fixture(scope="module")
def fitted(wide):
    return Dictionary.fit(wide, ["ip", "kind"])


def test_codes_are_places_in_sorted_order(spark, wide, fitted):
    assert fitted.sizes == {"ip": MANY, "kind": 2}
    place = {v: i for i, v in enumerate(sorted(f"a{i}" for i in range(MANY)))}
    got = fitted.table.where("column_name = 'ip'").collect()
    assert {r["value"]: r["code"] for r in got} == place
    coded = fitted.encode(wide, "ip", "code")
    assert coded.columns == [*wide.columns, "code"] and coded.count() == wide.count()
    back = fitted.decode(coded, "code", "ip", "again")
    assert back.where("NOT again <=> ip").count() == 0
    assert fitted.encode(wide, "kind", "code").where("(kind IS NULL) <> (code IS NULL)").count() == 0


def test_unseen_values(spark, fitted):
    df = spark.createDataFrame([("a5",), ("zz",), (None,)], "ip string")
    known = fitted.table.where("column_name = 'ip' AND value = 'a5'").first()["code"]
    assert {r["ip"]: r["c"] for r in fitted.encode(df, "ip", "c").collect()} == {"a5": known, "zz": None, None: None}
    assert {r["ip"]: r["c"] for r in fitted.encode(df, "ip", "c", "last").collect()} == {"a5": known, "zz": MANY, None: None}
    with pytest.raises(Exception, match="not seen in training"):
        fitted.encode(df, "ip", "c", "fail").collect()
    with pytest.raises(ValueError):
        fitted.encode(df, "ip", "c", "skip")


def test_no_branch_per_category(wide, fitted):
    out = io.StringIO()
    with redirect_stdout(out):
        fitted.encode(wide, "ip", "code").explain("formatted")
    text = out.getvalue()
    assert len(text) < 8_000 and "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_sparse_vectors(spark, wide, tmp_path):
    encoder = SparseEncoder.fit(wide, ["n"], ["ip", "kind"])
    assert encoder.width == MANY + 3
    probe = spark.createDataFrame([(1, "a5", "udp", 4), (2, "zz", None, 4), (3, None, "tcp", None)], "id long, ip string, kind string, n long")
    encoder.save(str(tmp_path / "sparse"))
    loaded = SparseEncoder.load(spark, str(tmp_path / "sparse"))
    code = encoder.dictionary.table.where("value = 'a5'").first()["code"]
    mean, std = encoder.numeric["n"]
    for one in (encoder, loaded):
        rows = {r["id"]: r["features"] for r in one.transform(probe).collect()}
        assert all(v.size == MANY + 3 for v in rows.values())
        assert dict(zip(rows[1].indices.tolist(), rows[1].values.tolist())) == {code: 1.0, MANY + 1: 1.0, MANY + 2: (4 - mean) / std}
        assert rows[2].indices.tolist() == [MANY + 2]
        assert rows[3].indices.tolist() == [MANY, MANY + 2] and rows[3].values[1] != rows[3].values[1]


def test_agrees_with_the_dense_encoder(spark):
    df = spark.createDataFrame([(i, f"k{i % 5}", None if i % 4 == 0 else f"m{i % 3}", float(i)) for i in range(60)], "id int, a string, b string, x double")
    dense = FlowEncoder.fit(df, ["x"], ["a", "b"])
    expected = {r["id"]: [round(v, 9) for v in r["features"].toArray()] for r in dense.assemble_encoded(dense.transform(df), ["id"]).collect()}
    sparse = SparseEncoder.fit(df, ["x"], ["a", "b"]).transform(df)
    assert {r["id"]: [round(v, 9) for v in r["features"].toArray()] for r in sparse.collect()} == expected


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id int, a string, x double")
    encoder = SparseEncoder.fit(empty, ["x"], ["a"])
    assert encoder.width == 1 and encoder.transform(empty).count() == 0
    rows = encoder.transform(spark.createDataFrame([(1, "b", 2.0)], "id int, a string, x double")).collect()
    assert rows[0]["features"].toArray().tolist() == [2.0]
