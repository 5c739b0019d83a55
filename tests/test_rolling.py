"""Trailing windows against the definition: every row rereads its whole group."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.functions.timing import window_micros
from flowtide.operators.rolling import Rolling, rolling, rolling_framed

FEATURES = [
    Rolling("c", "count", "port"),
    Rolling("s", "sum", "amount"),
    Rolling("m", "mean", "amount"),
    Rolling("u", "nunique", "port"),
    Rolling("e", "entropy", "port"),
]
SCHEMA = "row_id long, key string, ts long, port int, amount double"


def brute(rows, w):
    out = {}
    for row_id, key, ts, _, _ in rows:
        if key is None or ts is None:
            out[row_id] = (None,) * 5
            continue
        frame = [r for r in rows if r[1] == key and r[2] is not None and ts - w < r[2] <= ts]
        ports = [r[3] for r in frame if r[3] is not None]
        amounts = [r[4] for r in frame if r[4] is not None]
        shares = [n / len(ports) for n in Counter(ports).values()]
        out[row_id] = (
            len(ports),
            sum(amounts),
            sum(amounts) / len(amounts) if amounts else None,
            len(set(ports)),
            -sum(p * math.log2(p) for p in shares) if shares else 0.0,
        )
    return out


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def compare(spark, rows, w):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["row_id"]: tuple(r[f.name] for f in FEATURES) for r in rolling(df, "key", FEATURES, w).collect()}
    want = brute(rows, w)
    assert got.keys() == want.keys()
    for row_id, values in want.items():
        assert all(close(g, v) for g, v in zip(got[row_id], values)), (row_id, got[row_id], values)


# Few distinct times, so that ties and gaps of exactly the window are common.
row = st.tuples(
    st.sampled_from(["a", "a", "b", None]),
    st.one_of(st.none(), st.integers(-25, 25)),
    st.one_of(st.none(), st.integers(1, 3)),
    st.one_of(st.none(), st.sampled_from([0.5, 2.0, 1e9])),
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=40), st.sampled_from([1, 7, 10]))
def test_matches_definition(spark, rows, w):
    compare(spark, [(i, *r) for i, r in enumerate(rows)], w)


def test_row_exactly_one_window_back_is_outside(spark):
    rows = [(i, "k", t, 1, 1.0) for i, t in enumerate([0, 1_000_000, 1_000_001])]
    got = rolling(spark.createDataFrame(rows, SCHEMA), "key", FEATURES[:1], "1s").orderBy("row_id").collect()
    assert [r["c"] for r in got] == [1, 1, 2]


def test_equal_times_see_each_other(spark):
    rows = [(0, "k", 5, 1, 1.0), (1, "k", 5, 2, 1.0)]
    got = rolling(spark.createDataFrame(rows, SCHEMA), "key", FEATURES[:1], "1s").collect()
    assert [r["c"] for r in got] == [2, 2]


def test_entropy_golden(spark):
    rows = [(i, "k", 5, p, 1.0) for i, p in enumerate([1, 1, 2])]
    got = rolling(spark.createDataFrame(rows, SCHEMA), "key", [FEATURES[4]], "1s").first()
    assert got["e"] == pytest.approx(0.9182958340544896)


def test_hot_key_in_one_instant(spark):
    """A third of the rows share key and time; the rest are spread out."""
    rows = [(i, "hot", 77, i % 50, 1.0) for i in range(400)]
    rows += [(1000 + i, f"k{i % 9}", 7 * i, i % 5, 2.0) for i in range(300)]
    compare(spark, rows, 100)


def test_framed_form_agrees_and_takes_python_aggregates(spark):
    @F.pandas_udf(T.DoubleType())
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    rows = [(i, "ab"[i % 2], 3 * i, i % 4, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows + [(99, None, 1, 1, 1.0)], SCHEMA)
    framed = rolling_framed(df, "key", {"n": F.count("port"), "width": spread(F.col("amount"))}, 20)
    plain = rolling(df, "key", [Rolling("n", "count", "port")], 20)
    a = {r["row_id"]: r["n"] for r in framed.collect()}
    b = {r["row_id"]: r["n"] for r in plain.collect()}
    assert a == b and a[99] is None
    top = {r["row_id"]: r["width"] for r in framed.collect()}
    for i, key, ts, _, _ in rows:
        seen = [r[4] for r in rows if r[1] == key and ts - 20 < r[2] <= ts]
        assert top[i] == max(seen) - min(seen)


@pytest.mark.parametrize(
    ("text", "micros"),
    [("1s", 10**6), ("5min", 300 * 10**6), ("6h", 6 * 3600 * 10**6), ("6 hours", 6 * 3600 * 10**6), ("1day", 86400 * 10**6), ("250ms", 250_000), (7, 7)],
)
def test_window_sizes(text, micros):
    assert window_micros(text) == micros


def test_bad_window():
    with pytest.raises(ValueError):
        window_micros("soon")
