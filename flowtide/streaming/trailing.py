"""Exact trailing-window features of a stream, in Spark's keyed state with timers.

Time is cut into slices, ``slices`` to a window. The frame of a row, ``(t - w, t]``, is what came before it in its
own slice, all of the slices between, and what is later than ``t - w`` in the slice one window before. So the
state is kept per slice: the slice's own rows, the rows of the slice one window before, and sums of the slices
between, which are added up before the shuffle. Keys share ``lanes`` by their hash, so that many small ones cost no
more than a few calls; a source with most of the traffic is spread over its slices. A slice of a lane is computed
once, when the watermark has passed its end, for all its keys together and from bounded state.

A row is late if its slice is over by then; that is decided row by row in the operator, where all parts of a row
see the same watermark, so a late row counts nowhere. It comes out marked instead of being dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowtide.functions.timing import event_micros, window_micros
from flowtide.operators.rolling import Rolling

_OWN, _OLD, _BETWEEN, _KEYLESS = range(4)
#: Rows that are handed on at a time.
_BATCH = 10_000


def _columns(features: Sequence[Rolling]) -> list[str]:
    return list(dict.fromkeys(f.column for f in features))


def _numbers(features: Sequence[Rolling], column: str) -> bool:
    return any(f.column == column and f.kind in ("sum", "mean") for f in features)


def _values(features: Sequence[Rolling], column: str) -> bool:
    return any(f.column == column and f.kind in ("nunique", "entropy") for f in features)


def _fields(features: Sequence[Rolling]) -> list[tuple[str, str]]:
    """Known, number and value of every column that needs them."""
    out = []
    for i, column in enumerate(_columns(features)):
        out.append((f"f{i}", "long"))
        if _numbers(features, column):
            out.append((f"d{i}", "double"))
        if _values(features, column):
            out.append((f"t{i}", "string"))
    return out


def _batch(rows: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        array = pa.Array.from_pandas(rows[field.name], type=field.type) if field.name in rows else pa.nulls(len(rows), field.type)
        arrays.append(array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array)
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _spread(features: Sequence[Rolling], length: int, slices: int, lanes: int, schema: pa.Schema):
    """Every row to its own slice and to the one a window later, and its sums to the slices between."""
    fields = [name for name, _ in _fields(features)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            own = rows["us"] // length
            end = (own + 1) * length
            rows = rows.assign(slice=own, end_ms=-(-end // 1000), at=pd.to_datetime(end, unit="us", utc=True))
            keyed = rows[rows["key"].notna()]
            keyed = keyed.assign(lane=(pd.util.hash_pandas_object(keyed["key"], index=False) % lanes).astype("int64"))
            keyless = rows[rows["key"].isna()]
            parts = [keyed.assign(kind=_OWN), keyed.assign(kind=_OLD, slice=keyed["slice"] + slices),
                     keyless.assign(kind=_KEYLESS, lane=keyless["row_id"].fillna(0).astype("int64") % lanes)]
            at = ["lane", "key", "slice", "at", "end_ms"]
            if slices > 1 and len(keyed):
                sums = []
                for i, column in enumerate(_columns(features)):
                    facts = keyed.assign(n=keyed[f"f{i}"], s=keyed[f"d{i}"].fillna(0.0) if f"d{i}" in fields else 0.0)
                    sums.append(facts.groupby(at, as_index=False)[["n", "s"]].sum().assign(which=i, value=None))
                    if _values(features, column):
                        seen = facts[facts[f"t{i}"].notna()].rename(columns={f"t{i}": "value"})
                        sums.append(seen.groupby([*at, "value"], as_index=False)[["n", "s"]].sum().assign(which=i))
                between = pd.concat(sums, ignore_index=True).assign(kind=_BETWEEN)
                parts += [between.assign(slice=between["slice"] + j) for j in range(1, slices)]
            for part in parts:
                if len(part):
                    yield _batch(part, schema)

    return run


class _Slices(StatefulProcessor):
    """State of one (lane, slice)."""

    def __init__(self, features: Sequence[Rolling], key_kind: str, window: int, length: int):
        self.features, self.window, self.length = list(features), window, length
        self.held = _schema([("kind", "int"), ("key", key_kind), ("us", "long"), ("row_id", "long"), *_fields(features)])
        self.sums = _schema([("key", key_kind), ("which", "int"), ("value", "string"), ("n", "long"), ("s", "double")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "part binary")
        self.between = handle.getListState("between", "part binary")

    def _plain(self, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        out = pd.DataFrame({"key": rows["key"].to_numpy(), "row_id": rows["row_id"].astype("int64").to_numpy(), "late": late})
        return out.assign(**{f.name: None for f in self.features})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, open_ = timerValues.getCurrentWatermarkInMs(), False
        for part in rows:
            keyless = part[(part["kind"] == _KEYLESS) & part["row_id"].notna()]
            if len(keyless):
                yield self._plain(keyless, False)
            part = part[part["kind"] != _KEYLESS]
            late = part["end_ms"] <= mark
            lost = part[late & (part["kind"] == _OWN)]
            if len(lost):
                yield self._plain(lost, True)
            part = part[~late]
            open_ |= len(part) > 0
            for state, layout, some in (
                (self.rows, self.held, part[part["kind"] != _BETWEEN]), (self.between, self.sums, part[part["kind"] == _BETWEEN])):
                if len(some):
                    state.appendList([_packed(some, layout)])
        if open_:
            self.handle.registerTimer(-(-(int(key[1]) + 1) * self.length // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows, between = _unpacked(self.rows.get(), self.held), _unpacked(self.between.get(), self.sums)
        self.rows.clear()
        self.between.clear()
        own = rows[rows["kind"] == _OWN]
        if len(own):
            lane = _Lane(own, rows[rows["kind"] == _OLD], between, int(key[1]) * self.length, self.window)
            out = pd.DataFrame({"key": lane.own["key"].to_numpy(), "row_id": lane.own["row_id"].to_numpy(), "late": False})
            for f in self.features:
                out[f.name] = lane.read(f, _columns(self.features).index(f.column))
            for start in range(0, len(out), _BATCH):
                yield out.iloc[start : start + _BATCH]

    def close(self) -> None:
        pass


def _schema(layout: list[tuple[str, str]]) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(", ".join(f"{name} {kind}" for name, kind in layout)))


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    """Rows as one value of the state: Arrow's bytes, not a value for each row."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as writer:
        writer.write_batch(_batch(rows, schema))
    return (out.getvalue().to_pybytes(),)


def _unpacked(parts: Iterator[tuple], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(part)).read_all() for (part,) in parts]
    return pa.concat_tables([schema.empty_table(), *tables]).to_pandas()


class _Lane:
    """The rows of one slice of a lane, of all its keys. A place is a key's number and a time in one number, so that one
    sorted array serves all keys: each has four windows of room, and a slice's own rows stand after the first."""

    def __init__(self, own: pd.DataFrame, old: pd.DataFrame, between: pd.DataFrame, start: int, window: int):
        codes = pd.Index(own["key"].unique())
        self.keys, self.window, self.room = len(codes), window, 4 * window

        def placed(rows: pd.DataFrame, moved: int) -> pd.DataFrame:
            code = codes.get_indexer(rows["key"])
            at = code.astype("int64") * self.room + (rows["us"].to_numpy("int64") - start + window + moved)
            return rows.assign(code=code, at=at)[code >= 0].sort_values("at", kind="stable")

        self.own, self.old = placed(own, 0), placed(old, 0)
        code = codes.get_indexer(between["key"])
        self.between = between.assign(code=code)[code >= 0]
        self.now, self.code = self.own["at"].to_numpy("int64"), self.own["code"].to_numpy("int64")
        self.first = self.code * self.room

    def _span(self, places: np.ndarray, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of what stands from ``low`` on up to ``high``, both included."""
        upto = np.concatenate(([0], np.cumsum(values)))
        return upto[np.searchsorted(places, high, "right")] - upto[np.searchsorted(places, low, "left")]

    def _total(self, column: str, carried: pd.Series) -> np.ndarray:
        kept = np.zeros(self.keys, dtype=carried.dtype)
        np.add.at(kept, self.between.loc[carried.index, "code"].to_numpy("int64"), carried.to_numpy())
        seen = self._span(self.now, self.first, self.now, self.own[column].fillna(0).to_numpy())
        still = self._span(self.old["at"].to_numpy("int64"), self.now - self.window + 1, self.first + self.room - 1, self.old[column].fillna(0).to_numpy())
        return kept[self.code] + seen + still

    def read(self, f: Rolling, i: int) -> np.ndarray:
        """One feature for every row of ``own``."""
        carried = self.between[(self.between["which"] == i) & self.between["value"].isna()]
        n = self._total(f"f{i}", carried["n"].astype("int64")).astype("int64")
        if f.kind == "count":
            return n
        if f.kind in ("sum", "mean"):
            s = self._total(f"d{i}", carried["s"].astype("float64"))
            return s if f.kind == "sum" else np.where(n > 0, s / np.maximum(n, 1), np.nan)
        kinds, cost = self._distinct(f"t{i}", self.between[(self.between["which"] == i) & self.between["value"].notna()])
        if f.kind == "nunique":
            return kinds
        return np.where(kinds > 1, np.log2(np.maximum(n, 1)) - cost / np.maximum(n, 1), 0.0)

    def _distinct(self, column: str, between: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values in the frame of each row, and the sum of c * log2 c over their numbers of copies."""
        entering, leaving = self.own[self.own[column].notna()], self.old[self.old[column].notna()]
        code = np.concatenate((entering["code"], leaving["code"], between["code"])).astype("int64")
        value = pd.factorize(np.concatenate((entering[column], leaving[column], between["value"])).astype(object))[0]
        pair, of = np.unique(code * (value.max(initial=0) + 1) + value, return_inverse=True)
        n_in, n_moves = len(entering), len(entering) + len(leaving)
        # copies of each value of a key when its slice begins
        base = np.zeros(len(pair), "int64")
        np.add.at(base, of[n_in:n_moves], 1)
        np.add.at(base, of[n_moves:], between["n"].to_numpy("int64"))
        key_of = np.zeros(len(pair), "int64")
        key_of[of] = code
        first_kinds, first_cost = np.zeros(self.keys, "int64"), np.zeros(self.keys)
        np.add.at(first_kinds, key_of, (base > 0).astype("int64"))
        np.add.at(first_cost, key_of, _cost(base))
        at = np.concatenate((entering["at"].to_numpy("int64"), leaving["at"].to_numpy("int64") + self.window))
        order = np.argsort(at, kind="stable")
        at, which = at[order], of[:n_moves][order]
        step = np.concatenate((np.ones(n_in, "int64"), -np.ones(n_moves - n_in, "int64")))[order]
        after = base[which] + pd.Series(step).groupby(which).cumsum().to_numpy("int64")
        before = after - step
        kinds = self._span(at, self.first, self.now, (after > 0).astype("int64") - (before > 0))
        cost = self._span(at, self.first, self.now, _cost(after) - _cost(before))
        return first_kinds[self.code] + kinds, first_cost[self.code] + cost


def _cost(copies: np.ndarray) -> np.ndarray:
    return np.where(copies > 0, copies * np.log2(np.maximum(copies, 1)), 0.0)


def trailing(
    df: DataFrame, key: str, row_id: str, features: Sequence[Rolling], window: str | int, delay: str | int, ts: str = "ts", slices: int = 8, lanes: int = 16
) -> DataFrame:
    """Key, row id, the features and ``late`` of every row of a stream with a time.

    Rows that arrive up to ``delay`` behind the latest time are on time. A row comes out when the watermark passes
    its slice; late rows come out at once, marked and without features, and so do rows without a key, unmarked.
    A stream ends with a row that has neither key nor id and a time past the last slice: it moves the watermark
    and comes out nowhere. The state store must be RocksDB (``write_stream`` sees to it). ``row_counts`` of the
    running query has the rows read, and of those that came out the late ones.
    """
    span = window_micros(window)
    slices = max(s for s in range(1, slices + 1) if span % s == 0)
    length = span // slices
    columns = _columns(features)
    rows = df.select(
        F.col(key).alias("key"), F.col(row_id).cast("long").alias("row_id"), event_micros(df, ts).alias("us"),
        *[x for i, c in enumerate(columns) for x in (
            F.col(c).isNotNull().cast("long").alias(f"f{i}"),
            *([F.col(c).cast("double").alias(f"d{i}")] if _numbers(features, c) else []),
            *([F.col(c).cast("string").alias(f"t{i}")] if _values(features, c) else []))],
    ).where(F.col("us").isNotNull()).observe("read", F.count("row_id").alias("rows"))
    kind = df.schema[key].dataType.simpleString()
    fields = ", ".join(f"{name} {t}" for name, t in _fields(features))
    layout = T._parse_datatype_string(
        f"lane long, key {kind}, slice long, at timestamp, end_ms long, kind int, us long, row_id long, {fields}, which int, value string, n long, s double")
    spread = rows.mapInArrow(_spread(features, length, slices, lanes, to_arrow_schema(layout)), layout)
    types = {"count": "long", "nunique": "long"}
    out = ", ".join(f"{f.name} {types.get(f.kind, 'double')}" for f in features)
    return (
        spread.withWatermark("at", f"{window_micros(delay) + length} microseconds")
        .drop("at")
        .groupBy("lane", "slice")
        .transformWithStateInPandas(_Slices(features, kind, span, length), f"key {kind}, row_id long, late boolean, {out}", "Append", "EventTime")
        .select(F.col("key").alias(key), F.col("row_id").alias(row_id), *[f.name for f in features], "late")
        .observe("emitted", F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"))
    )
