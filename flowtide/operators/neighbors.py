"""Nearest-neighbour joins, exact and by hashing, and the operators built on them.

Exact search. Distances obey the triangle inequality, so most of the work can be ruled out beforehand:

* of equal references only the first ``k`` are kept and of equal queries one is asked, so copies are not compared;
* pivots are drawn from the references, as many as the square root of their number, and grouped around the
  square root of that; every reference goes to the nearest group and there to the cell of its nearest pivot, so
  it is compared with twice the fourth root of the references;
* per cell, the size, the span of distances to its pivot and its ``k`` smallest distances are collected, a table
  bounded by pivots x k numbers;
* each query bounds the distance of its k-th neighbour from the cells of its nearest groups, rules out whole
  groups, then cells of the groups that are left, and visits only what could hold something nearer.

Search by hashing (``nearest_hashed``) places every reference in one bucket of each of several tables, the signs of
its products with random directions, and a query visits its bucket and those that differ in its least certain signs.

Either way a cell or bucket with many references is cut into chunks, neighbouring small cells share one, and the
visits of a chunk are cut into blocks, so a task compares one bounded block with one bounded chunk and keeps ``k``
rows per query. A reference is copied once for each block of visits to its chunk, not for the queries there are.
Within a task cheap bounds (a matrix product, or sums of small whole numbers) rule out nearly all pairs, and only
the distances of the rest are computed. The ranking runs over the survivors only. No cross join is planned, and
exact search skips no reference that could be among the ``k`` nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.functions.vectors import l2_normalize
from flowtide.operators.sampling import hash_key
from flowtide.session import materialize, spread

METRICS = ("euclidean", "manhattan", "chebyshev", "minkowski", "cosine")
_SLAB = 1 << 22  # numbers held at once while planning the visits of queries
_STEP = 1 << 16  # the same while computing distances: they stay in a core's cache
#: Pivots that are collected at most; with more references the cells have more chunks.
MAX_PIVOTS = 1 << 14
#: Groups whose cells bound the distance of a query's neighbours.
_NEAR_GROUPS = 3
#: Vectors that are placed at a time, and queries whose visits are planned at a time.
_BATCH = 4096


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64, copy=False) if len(vectors) else np.empty((0, 0))


def distances(a: np.ndarray, b: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """All distances between the rows of two small blocks, from plain differences so that equal
    vectors give equal distances wherever they are stored."""
    out = np.empty((len(a), len(b)))
    step = max(1, _STEP // max(1, b.size))
    for start in range(0, len(a), step):
        gap = np.abs(a[start : start + step, None, :] - b[None, :, :])
        if metric == "manhattan":
            out[start : start + step] = gap.sum(axis=2)
        elif metric == "chebyshev":
            out[start : start + step] = gap.max(axis=2)
        elif metric == "minkowski" and p != 2.0:
            out[start : start + step] = (gap**p).sum(axis=2) ** (1.0 / p)
        else:
            out[start : start + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


#: Queries and references that are screened at a time: both matrices of a step stay in a core's cache.
_SCREEN = (128, 512)
#: Whole numbers keep to 15 bits, their sums too.
_WHOLE = 32_000


class _Screen:
    """Cheap bounds on the distances of a block of queries to references, in a space of its own that grows with the
    distance: squares for ``euclidean``, distances in units of the grid for the others. ``near`` gives numbers that are
    no further than ``slack`` (by query) from the exact ones, as ``exact`` puts them."""

    def __init__(self, some: np.ndarray, others: np.ndarray, metric: str, whole: bool):
        self.metric, self.power, self.unit, dims = metric, 1.0, 1.0, max(1, some.shape[1])
        middle = others.mean(axis=0)
        a, b = some - middle, others - middle
        tiny, moved = (dims + 16) * 1.2e-7, 4e-16 * max(np.abs(some).max(initial=0.0), np.abs(others).max(initial=0.0))
        if metric not in ("manhattan", "chebyshev"):
            self.power = 2.0
            size_a, size_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            reach = size_a + size_b.max(initial=0.0)
            self.slack = tiny * reach**2 + 2 * reach * dims**0.5 * moved + dims * moved**2
            self.a, self.b = a.astype(np.float32), b.astype(np.float32)
            self.squares_a, self.squares_b = (size_a**2).astype(np.float32), (size_b**2).astype(np.float32)
            return
        low = min(a.min(initial=0.0), b.min(initial=0.0))
        span = max(a.max(initial=0.0), b.max(initial=0.0)) - low
        if whole:
            added = dims if metric == "manhattan" else 1
            self.unit = max(span, 1e-300) / (_WHOLE // added)
            a, b = np.rint((a - low) / self.unit), np.rint((b - low) / self.unit)
            # each number is half a unit off at most
            self.slack = np.full(len(a), added * (1.01 + 2 * moved / self.unit) + 1.0)
        else:
            self.slack = 4 * tiny * (np.abs(a).sum(axis=1) + np.abs(b).sum(axis=1).max(initial=0.0)) + 2 * dims * moved
        kind = np.int16 if whole else np.float32
        self.a, self.b = np.ascontiguousarray(a.T.astype(kind)), np.ascontiguousarray(b.T.astype(kind))
        self.sums_a, self.sums_b = self.a.sum(axis=0, dtype=np.float32), self.b.sum(axis=0, dtype=np.float32)

    def exact(self, d: np.ndarray) -> np.ndarray:
        return (d / self.unit) ** self.power

    def of_rows(self, start: int) -> _Screen:
        """The same screen for the queries from ``start`` on, of distances in units of the grid."""
        out = copy(self)
        out.a, out.sums_a, out.slack = self.a[:, start:], self.sums_a[start:], self.slack[start:]
        return out

    def passing(self, k: int) -> float:
        """Share of the first pairs that are let through."""
        rows = slice(0, _SCREEN[0])
        near = self.near(rows, slice(0, _SCREEN[1]))
        if near.shape[1] <= 20 * k:
            return 0.0
        limit = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * self.slack[rows]
        return float((near <= limit[:, None]).mean())

    def near(self, rows: slice, columns: slice) -> np.ndarray:
        if self.power == 2.0:
            return self.squares_a[rows, None] + self.squares_b[None, columns] - 2 * (self.a[rows] @ self.b[columns].T)
        a, b = self.a[:, rows], self.b[:, columns]
        total = np.zeros((a.shape[1], b.shape[1]), a.dtype)
        step = np.empty_like(total)
        if self.metric == "manhattan":  # |x - y| = 2 max(x, y) - x - y
            for x, y in zip(a, b):
                np.maximum(x[:, None], y[None, :], out=step)
                total += step
            return 2 * total.astype(np.float32) - self.sums_a[rows, None] - self.sums_b[None, columns]
        for x, y in zip(a, b):
            np.subtract(x[:, None], y[None, :], out=step)
            np.maximum(total, np.abs(step, out=step), out=total)
        return total.astype(np.float32)


#: Queries that are screened at a time where boxes rule out little, and where the references are cut for it: the first part
#: bounds the distances to look for, the later ones tighten them.
_FLAT = {"manhattan": 1024, "chebyshev": 128}
_CUTS = {"manhattan": (512, 2048, 6144), "chebyshev": (512, 2048)}
#: |x - y| >= sum of a * (1 - cos(w * (x - y))) for all x and y, as close below as two waves come for normal numbers.
_WAVES = ((1.2312, 1.06967933), (0.1695, 3.09875533))
#: Bits of a chunk's tables of ranges, and the ranges of a column at most.
_RANGE_BITS, _RANGES = 1 << 29, 128


class _Waves:
    """Lower bounds of manhattan distances from one matrix product: a sum of waves lies below every gap."""

    def __init__(self, some: np.ndarray, others: np.ndarray, screen: _Screen, parts: list[slice]):
        middle, scale = others.mean(axis=0), others.std(axis=0)
        scale[scale == 0] = 1.0
        self.parts, self.total = parts, float(scale.sum()) * sum(a for a, _ in _WAVES) / screen.unit

        def waves(rows: np.ndarray) -> np.ndarray:
            out = []
            for a, w in _WAVES:
                at, high = (rows - middle) / scale * w, np.sqrt(a * scale / screen.unit)
                out += [(np.cos(at) * high).astype(np.float32), (np.sin(at) * high).astype(np.float32)]
            return np.concatenate(out, axis=1)

        self.a, self.b = waves(some), waves(others)
        self.some, self.others = (((rows - middle) / screen.unit).astype(np.float32) for rows in (some, others))
        dims, moved = some.shape[1], 4e-16 * max(np.abs(some).max(initial=0.0), np.abs(others).max(initial=0.0))
        self.slack = (4 * dims + 16) * 5e-7 * self.total + 8 * dims * moved / screen.unit + 1.0
        largest = np.abs(self.some).sum(axis=1).max(initial=0.0) + np.abs(self.others).sum(axis=1).max(initial=0.0)
        self.close = (dims + 16) * 5e-7 * largest + 8 * dims * moved / screen.unit + 1.0

    def candidates(self, rows: slice, part: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the rows and of a part that may be within the limits of the rows: places in both."""
        columns = self.parts[part]
        least = (self.total - limit * (1 + 1e-6) - self.slack).astype(np.float32)
        q, r = np.divmod(np.flatnonzero(self.a[rows] @ self.b[columns].T >= least[:, None]), columns.stop - columns.start)
        most = (limit * (1 + 1e-6) + self.close).astype(np.float32)
        some, others = self.some[rows], self.others[columns]
        step, close, ones = max(1, _STEP // max(1, some.shape[1])), [], np.ones(some.shape[1], np.float32)
        for start in range(0, len(q), step):
            asked = q[start : start + step]
            gap = some[asked]
            gap -= others[r[start : start + step]]
            close.append(np.abs(gap, out=gap) @ ones <= most[asked])
        kept = np.flatnonzero(np.concatenate(close)) if close else q
        return q[kept], columns.start + r[kept]


class _Ranges:
    """The references of a part whose columns are all within a range, by tables of bits: for each column and some of its
    numbers, which references are below."""

    def __init__(self, some: np.ndarray, others: np.ndarray, screen: _Screen, parts: list[slice]):
        self.parts, self.screen, self.tables = parts, screen, []
        ranges = max(8, min(_RANGES, _RANGE_BITS // screen.b.size))
        self.edges = []
        for column in screen.b:
            ordered = np.sort(column)
            self.edges.append(np.unique(ordered[np.arange(1, ranges) * len(ordered) // ranges]).astype(np.int32))
        for part in parts:
            own, words = [], -(-(part.stop - part.start) // 64)
            for column, edges in zip(screen.b, self.edges):
                below = np.zeros((len(edges) + 2, 64 * words), bool)
                below[1:-1, : part.stop - part.start] = column[None, part] < edges[:, None]
                below[-1, : part.stop - part.start] = True
                own.append(np.packbits(below, axis=1, bitorder="little").view(np.uint64))
            self.tables.append(own)

    def candidates(self, rows: slice, part: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the rows and of a part that may be within the limits of the rows: places in both."""
        reach = np.minimum((limit + self.screen.slack[rows]) * (1 + 1e-6), 1e6).astype(np.int32)
        columns, both, one, other = self.parts[part], None, None, None
        for own, edges, numbers in zip(self.tables[part], self.edges, self.screen.a):
            asked = numbers[rows].astype(np.int32)
            # the first edge above the range, and the last one that is not inside it
            high, low = np.searchsorted(edges, asked + reach, side="right") + 1, np.searchsorted(edges, asked - reach, side="right")
            if both is None:
                both, one, other = (np.empty((len(asked), own.shape[1]), np.uint64) for _ in range(3))
                both.fill(np.iinfo(np.uint64).max)
            np.take(own, high, axis=0, out=one, mode="clip")
            np.take(own, low, axis=0, out=other, mode="clip")
            np.bitwise_xor(one, other, out=one)
            np.bitwise_and(both, one, out=both)
        held = np.flatnonzero(both)
        word, bit = np.nonzero(np.unpackbits(both.ravel()[held].view(np.uint8), bitorder="little").reshape(-1, 64))
        q, at = np.divmod(held[word], both.shape[1])
        return q, columns.start + at * 64 + bit


def _flat_places(
    a: np.ndarray, b: np.ndarray, screen: _Screen, k: int, within: np.ndarray, codes: tuple[np.ndarray, np.ndarray] | None, order_of: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``a``, rows of ``b`` and distances of the ``k`` nearest, for vectors among which boxes rule out little: bounds
    that are cheaper than those of ``screen`` leave some pairs, of which the distances are computed."""
    first, *rest = np.split(np.arange(len(b)), [c for c in _CUTS[screen.metric] if c < len(b)])
    # a product of at most so many columns
    parts = [slice(x[i], min(x[-1] + 1, x[i] + 4096)) for x in rest for i in range(0, len(x), 4096)] if screen.metric == "manhattan" else [
        slice(x[0], x[-1] + 1) for x in rest]
    bounds = (_Waves if screen.metric == "manhattan" else _Ranges)(a, b, screen, parts)
    for start in range(0, len(a), _FLAT[screen.metric]):
        stop = min(len(a), start + _FLAT[screen.metric])
        limit = within[start:stop].copy()
        best_q, best_r, best_d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for part in range(-1, len(parts)):
            if part >= 0:
                q, r = bounds.candidates(slice(start, stop), part, screen.exact(limit))
            else:
                q, r = _first_candidates(screen, slice(start, stop), slice(0, len(first)), k, limit, codes)
            if codes is not None:
                other = (codes[0][start + q] != codes[1][r]) | (codes[0][start + q] < 0)
                q, r = q[other], r[other]
            d = _paired(a, start + q, b, r, screen.metric, 2.0)
            near = d <= limit[q]
            best_q, best_r, best_d = np.concatenate((best_q, q[near])), np.concatenate((best_r, r[near])), np.concatenate((best_d, d[near]))
            order = np.lexsort((order_of[best_r], best_d, best_q))
            best_q, best_r, best_d = best_q[order], best_r[order], best_d[order]
            place = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            best_q, best_r, best_d, place = (x[place < k] for x in (best_q, best_r, best_d, place))
            limit[best_q[place == k - 1]] = best_d[place == k - 1]
        real = np.isfinite(best_d)
        yield start + best_q[real], best_r[real], best_d[real]


def _first_candidates(
    screen: _Screen, rows: slice, columns: slice, k: int, limit: np.ndarray, codes: tuple[np.ndarray, np.ndarray] | None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows with the first references that may be among their ``k`` nearest."""
    found_q, found_r = [], []
    for start in range(rows.start, rows.stop, _SCREEN[0]):
        some = slice(start, min(rows.stop, start + _SCREEN[0]))
        near = screen.near(some, columns)
        if codes is not None:
            near[(codes[0][some, None] == codes[1][None, columns]) & (codes[0][some, None] >= 0)] = np.inf
        slack, most = screen.slack[some], screen.exact(limit[some.start - rows.start : some.stop - rows.start])
        if near.shape[1] >= k:
            most = np.minimum(most, np.partition(near, k - 1, axis=1)[:, k - 1] + slack)
        q, r = np.nonzero((near <= ((most + slack) * (1 + 1e-6)).astype(near.dtype)[:, None]) & (near < np.inf))
        found_q.append(some.start - rows.start + q)
        found_r.append(columns.start + r)
    return np.concatenate(found_q), np.concatenate(found_r)


def _paired(a: np.ndarray, q: np.ndarray, b: np.ndarray, r: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of some pairs of rows of two blocks, the same numbers as ``distances`` gives."""
    out = np.empty(len(q))
    step = max(1, _STEP // max(1, a.shape[1]))
    for start in range(0, len(q), step):
        some = slice(start, start + step)
        gap = np.abs(a[q[some]] - b[r[some]])
        if metric == "manhattan":
            out[some] = gap.sum(axis=1)
        elif metric == "chebyshev":
            out[some] = gap.max(axis=1)
        else:
            out[some] = np.sqrt((gap * gap).sum(axis=1))
    return out


def _needed(vectors: np.ndarray, k: int, codes: np.ndarray | None) -> np.ndarray:
    """Places of the references that can be among the ``k`` first: of equal vectors the first ``k``. With ``codes``, the
    ids, of which a query leaves out its own: ``k`` rows of each of the first ``k + 1`` ids."""
    if not len(vectors):
        return np.empty(0, np.int64)
    held = np.ascontiguousarray(vectors + 0.0)  # no negative zeros
    of = np.unique(held.view(f"V{held.shape[1] * held.itemsize}").ravel(), return_inverse=True)[1] if held.shape[1] else np.zeros(len(held), np.int64)
    rows = pd.DataFrame({"of": of, "at": np.arange(len(of))})
    if codes is None:
        return np.flatnonzero((rows.groupby("of").cumcount() < k).to_numpy())
    rows["code"] = codes
    ids = rows.drop_duplicates(["of", "code"])
    rows = rows.merge(ids.assign(place=ids.groupby("of").cumcount())[["of", "code", "place"]], on=["of", "code"], how="left")
    return np.flatnonzero(((rows["place"] <= k) & (rows.groupby(["of", "code"]).cumcount() < k)).to_numpy())


def _together(vectors: np.ndarray, leaf: int) -> np.ndarray:
    """The rows in an order in which ``leaf`` consecutive ones lie together: halves along the widest column, again and again."""
    done, open_parts = [], [np.arange(len(vectors))]
    while open_parts:
        rows = open_parts.pop()
        own = vectors[rows]
        span = own.max(axis=0) - own.min(axis=0) if len(rows) > leaf and own.shape[1] else np.zeros(1)
        if not span.max(initial=0.0) > 0:
            done.append(rows)
            continue
        half = -(-len(rows) // (2 * leaf)) * leaf
        cut = np.argpartition(own[:, span.argmax()], half - 1)
        open_parts += [rows[cut[half:]], rows[cut[:half]]]
    return np.concatenate(done) if done else np.empty(0, np.int64)


def _to_boxes(some: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of rows to boxes: no row of a box is nearer."""
    gap = np.maximum(0.0, np.maximum(low[None] - some[:, None], some[:, None] - high[None]))
    if metric == "manhattan":
        out = gap.sum(axis=2)
    elif metric == "chebyshev":
        out = gap.max(axis=2, initial=0.0)
    elif metric == "minkowski" and p != 2.0:
        out = (gap**p).sum(axis=2) ** (1.0 / p)
    else:
        out = np.sqrt((gap * gap).sum(axis=2))
    return out * (1 - 1e-9)


def nearest_places(
    some: np.ndarray, others: np.ndarray, k: int, metric: str, p: float = 2.0, ids: tuple[np.ndarray, np.ndarray] | None = None,
    within: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``some``, row of ``others`` and distance of the ``k`` nearest, by row and distance; ties go to the first of
    ``others``. With ``ids`` of both sides a row does not meet its own id. Rows with a number that is not finite meet nothing.
    With ``within`` a row may leave out what is further than its number there.

    Rows that lie together are compared together, those of a box beyond the ``k`` nearest found so far are left out, and bounds
    rule out nearly all other pairs; the distances of the rest are computed as ``distances`` does.
    """
    codes = None
    if ids is not None:
        codes = pd.factorize(np.concatenate((np.asarray(ids[0], object), np.asarray(ids[1], object))))[0]
        codes = codes[: len(some)], codes[len(some) :]
    asking = np.flatnonzero(np.isfinite(some).all(axis=1))
    kept = np.flatnonzero(np.isfinite(others).all(axis=1))
    kept = kept[_needed(others[kept], k, None if codes is None else codes[1][kept])]
    nothing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(asking) or not len(kept):
        return nothing
    asking, kept = asking[_together(some[asking], _SCREEN[0])], kept[_together(others[kept], _SCREEN[1])]
    own_q, own_r = nothing[:2]
    if codes is not None:
        mine, theirs = pd.DataFrame({"c": codes[0][asking], "q": np.arange(len(asking))}), pd.DataFrame({"c": codes[1][kept], "r": np.arange(len(kept))})
        own = mine[mine["c"] >= 0].merge(theirs, on="c")
        own_q, own_r = own["q"].to_numpy("int64"), own["r"].to_numpy("int64")
    a, b = some[asking], others[kept]
    largest = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    screen = None  # without one, all distances are computed
    if a.shape[1] and largest < 1e15 and (metric != "minkowski" or p == 2.0):
        screen = _Screen(a, b, metric, metric in ("manhattan", "chebyshev") and a.shape[1] <= 1024)
        if screen.unit != 1.0 and screen.passing(k) > 0.05:  # a few far numbers make the grid too coarse
            screen = _Screen(a, b, metric, False)
    firsts = np.arange(0, len(b), _SCREEN[1])
    low, high = np.minimum.reduceat(b, firsts, axis=0), np.maximum.reduceat(b, firsts, axis=0)
    found = []
    for start in range(0, len(a), _SCREEN[0]):
        stop = min(len(a), start + _SCREEN[0])
        slack = screen.slack[start:stop] if screen else np.zeros(stop - start)
        away = _to_boxes(a[start:stop], low, high, metric, p)
        boxes = np.argsort(away.min(axis=0), kind="stable")
        away = screen.exact(away) if screen else away
        best_q, best_r, best_d = nothing
        compared = 0
        limit = np.full(stop - start, np.inf) if within is None else within[asking[start:stop]]
        limit = screen.exact(limit) if screen else limit
        mine = (own_q >= start) & (own_q < stop)
        mine_q, mine_r = own_q[mine] - start, own_r[mine]
        for box in boxes:
            asks = np.flatnonzero(away[:, box] <= limit * (1 + 1e-6))
            if not len(asks):
                continue
            compared += len(asks)
            first = firsts[box]
            columns = slice(first, min(len(b), first + _SCREEN[1]))
            rows = slice(start, stop) if len(asks) == stop - start else start + asks
            near = screen.near(rows, columns) if screen else distances(a[rows], b[columns], metric, p)
            if len(mine_r):
                place = np.full(stop - start, -1)
                place[asks] = np.arange(len(asks))
                at = (mine_r >= first) & (mine_r < columns.stop) & (place[mine_q] >= 0)
                near[place[mine_q[at]], mine_r[at] - first] = np.inf
            if (box == boxes[0] or np.isinf(limit[asks]).any()) and near.shape[1] >= k:
                limit[asks] = np.minimum(limit[asks], np.partition(near, k - 1, axis=1)[:, k - 1] + slack[asks])
            most = ((limit[asks] + slack[asks]) * (1 + 1e-6)).astype(near.dtype)
            q, r = np.nonzero((near <= most[:, None]) & (near < np.inf))
            if not len(q):
                continue
            q, r = asks[q], first + r
            d = _paired(a, start + q, b, r, metric, p) if screen else near[np.searchsorted(asks, q), r - first]
            best_q, best_r, best_d = np.concatenate((best_q, q)), np.concatenate((best_r, r)), np.concatenate((best_d, d))
            order = np.lexsort((kept[best_r], best_d, best_q))
            best_q, best_r, best_d = best_q[order], best_r[order], best_d[order]
            place = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            best_q, best_r, best_d, place = (x[place < k] for x in (best_q, best_r, best_d, place))
            full = place == k - 1
            limit[best_q[full]] = screen.exact(best_d[full]) if screen else best_d[full]
        real = np.isfinite(best_d)
        found.append((asking[start + best_q[real]], kept[best_r[real]], best_d[real]))
        # where boxes rule out little, other bounds are cheaper for the rest
        if screen and screen.unit != 1.0 and len(b) >= 4 * _SCREEN[1] > 80 * k and 2 * compared >= len(limit) * len(firsts):
            most = np.full(len(a) - stop, np.inf) if within is None else within[asking[stop:]]
            same = None if codes is None else (codes[0][asking[stop:]], codes[1][kept])
            for q, r, d in _flat_places(a[stop:], b, screen.of_rows(stop), k, most, same, kept):
                found.append((asking[stop + q], kept[r], d))
            break
    q, r, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((r, d, q))
    return q[order], r[order], d[order]


@dataclass
class CellIndex:
    """What a task needs to place references and to plan the visits of queries."""

    metric: str
    p: float
    pivots: np.ndarray  # in the order of their groups
    groups: np.ndarray  # centre of each group
    first: np.ndarray  # first pivot of each group, and the number of pivots
    size: np.ndarray | None = None  # by cell: references, least and greatest distance to the pivot, first chunk and chunks
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    first_chunk: np.ndarray | None = None
    chunks: np.ndarray | None = None
    inner: np.ndarray | None = None  # smallest distances to the pivot, padded with infinity

    @staticmethod
    def of(pivots: np.ndarray, metric: str, p: float) -> CellIndex:
        groups = pivots[: max(1, round(len(pivots) ** 0.5))]
        group = np.concatenate([distances(pivots[i : i + _BATCH], groups, metric, p).argmin(axis=1) for i in range(0, len(pivots), _BATCH)])
        order = np.argsort(group, kind="stable")
        return CellIndex(metric, p, pivots[order], groups, np.searchsorted(group[order], np.arange(len(groups) + 1)))

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot of each vector."""
        group = distances(vectors, self.groups, self.metric, self.p).argmin(axis=1)
        cell, far = np.empty(len(vectors), np.int64), np.empty(len(vectors))
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            start, stop = self.first[g], self.first[g + 1]
            if start == stop:  # no pivot is nearest to this centre; the centres are pivots themselves, so a copy of another one
                start, stop = 0, len(self.pivots)
            d = distances(vectors[rows], self.pivots[start:stop], self.metric, self.p)
            best = d.argmin(axis=1)
            cell[rows], far[rows] = start + best, d[np.arange(len(rows)), best]
        return cell, far

    def summarise(self, facts: list, margin: int, chunk_rows: int) -> None:
        """Take over what was collected of the cells."""
        n = len(self.pivots)
        self.size, self.low, self.high = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
        self.inner = np.full((n, margin), np.inf)
        for row in facts:
            cell = row["cell"]
            self.size[cell], self.low[cell], self.high[cell] = row["n"], row["lo"], row["hi"]
            near = np.sort(row["near"])[:margin]
            self.inner[cell, : len(near)] = near
        # neighbouring cells share a chunk while they fit; a cell that does not fit has chunks of its own
        self.chunks, self.first_chunk = np.maximum(1, -(-self.size // chunk_rows)), np.zeros(n, np.int64)
        self.starts, filled = [0], self.size[0]
        for cell in range(1, n):
            if filled + self.size[cell] > chunk_rows:
                self.first_chunk[cell] = self.first_chunk[cell - 1] + self.chunks[cell - 1]
                self.starts.append(cell)
                filled = 0
            else:
                self.first_chunk[cell] = self.first_chunk[cell - 1]
            filled += self.size[cell]
        #: no reference of a group is further from its centre
        self.radius = np.full(len(self.groups), -np.inf)
        for g in range(len(self.groups)):
            cells = slice(self.first[g], self.first[g + 1])
            held = self.size[cells] > 0
            if held.any():
                own = distances(self.groups[g : g + 1], self.pivots[cells], self.metric, self.p)[0]
                self.radius[g] = (own + self.high[cells])[held].max()

    def visits(self, vectors: np.ndarray, margin: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Chunks that each query has to visit, and the distance that its last wanted neighbour has at most. Only the cells of
        the groups that a query cannot rule out are looked at."""
        to_groups = distances(vectors, self.groups, self.metric, self.p)
        near = np.zeros(to_groups.shape, bool)
        np.put_along_axis(near, np.argsort(to_groups, axis=1, kind="stable")[:, :_NEAR_GROUPS], True, axis=1)
        # the smallest distances that some references are known to have at most, the last of them the bound
        best = np.full((len(vectors), margin), np.inf)
        for g in range(len(self.groups)):
            for rows, known in self._looked(vectors, np.flatnonzero(near[:, g]), g, margin):
                self._tighten(best, rows, known, g)
        for g in range(len(self.groups)):
            open_to = (to_groups[:, g] - self.radius[g] <= self._bound(best)) & ~near[:, g]
            for rows, known in self._looked(vectors, np.flatnonzero(open_to), g, margin):
                self._tighten(best, rows, known, g)
        bound, found = self._bound(best), [np.empty(0, np.int64)]
        run_of = np.searchsorted(self.starts, np.arange(len(self.pivots)), side="right") - 1
        for g in range(len(self.groups)):
            cells = slice(self.first[g], self.first[g + 1])
            low, high, held = self.low[cells], self.high[cells], self.size[cells] > 0
            for rows, known in self._looked(vectors, np.flatnonzero(to_groups[:, g] - self.radius[g] <= bound), g, margin):
                limit = bound[rows, None]
                at, cell = np.nonzero((known - high <= limit) & (low - known <= limit) & held)
                found.append(np.unique(rows[at] * len(self.starts) + run_of[cells][cell]))
        row, at = np.divmod(np.unique(np.concatenate(found)), len(self.starts))
        first, many = self.first_chunk[self.starts][at], self.chunks[self.starts][at]
        ends = np.cumsum(many)
        chunk = np.repeat(first - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)
        return np.split(chunk, np.searchsorted(np.repeat(row, many), np.arange(1, len(vectors)))), bound

    def _looked(self, vectors: np.ndarray, rows: np.ndarray, g: int, margin: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some of the rows at a time, and their distances to the pivots of a group."""
        pivots = self.pivots[self.first[g] : self.first[g + 1]]
        step = max(1, _SLAB // max(1, len(pivots) * margin))
        for start in range(0, len(rows) if len(pivots) else 0, step):
            some = rows[start : start + step]
            yield some, distances(vectors[some], pivots, self.metric, self.p)

    def _tighten(self, best: np.ndarray, rows: np.ndarray, known: np.ndarray, g: int) -> None:
        """Take the references of a group's cells into the smallest known distances of the rows."""
        reach = known[:, :, None] + self.inner[self.first[g] : self.first[g + 1]]
        both = np.concatenate((best[rows], reach.reshape(len(rows), -1)), axis=1)
        best[rows] = np.partition(both, best.shape[1] - 1, axis=1)[:, : best.shape[1]]

    @staticmethod
    def _bound(best: np.ndarray) -> np.ndarray:
        """No less than the distance of each query's last wanted neighbour, from the cells it knows its distance to."""
        return best.max(axis=1) * (1 + 1e-9) + 1e-12


def _cell_index(right: DataFrame, metric: str, p: float, margin: int, pivots: int | None, chunk_rows: int) -> CellIndex | None:
    """Draw the pivots and collect the cells; None without references."""
    wanted = pivots or min(MAX_PIVOTS, max(1, round(right.count() ** 0.5)))
    drawn = right.orderBy(hash_key("__r"), "__r").limit(wanted).select("__v").collect()
    if not drawn:
        return None
    index = CellIndex.of(np.asarray([r["__v"] for r in drawn], dtype=np.float64), metric, p)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each cell of a task: at most ``margin`` numbers and three facts."""
        n, lo, hi = np.zeros(len(index.pivots), np.int64), np.full(len(index.pivots), np.inf), np.full(len(index.pivots), -np.inf)
        cells, near = np.empty(0, np.int64), np.empty(0)  # the smallest distances of each cell, in its order
        for rows in batches:
            for start in range(0, len(rows), _BATCH):
                cell, far = index.place(_matrix(rows["__v"].iloc[start : start + _BATCH]))
                n += np.bincount(cell, minlength=len(n))
                np.minimum.at(lo, cell, far)
                np.maximum.at(hi, cell, far)
                cells, near = np.concatenate((cells, cell)), np.concatenate((near, far))
                order = np.lexsort((near, cells))
                cells, near = cells[order], near[order]
                kept = np.arange(len(cells)) - np.searchsorted(cells, cells) < margin
                cells, near = cells[kept], near[kept]
        held = np.flatnonzero(n)
        if len(held):
            yield pd.DataFrame({"cell": held, "n": n[held], "lo": lo[held], "hi": hi[held], "near": np.split(near, np.searchsorted(cells, held[1:]))})

    parts = right.select("__v").mapInPandas(summarise, "cell long, n long, lo double, hi double, near array<double>")
    facts = parts.groupBy("cell").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.flatten(F.collect_list("near")).alias("near"))
    index.summarise(facts.collect(), margin, chunk_rows)
    return index


def _copies(visiting: DataFrame, placed: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by ``__chunk`` and ``__block``: the visits of a chunk are cut into blocks, and its references are there
    once for each block."""
    blocks = materialize(
        visiting.groupBy("__chunk").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("long").alias("__blocks")), "visits-by-chunk")
    asked = visiting.join(blocks, "__chunk").withColumn("__block", F.pmod(F.xxhash64("__q"), F.col("__blocks"))).drop("__blocks")
    held = placed.join(blocks, "__chunk").withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))).drop("__blocks")
    return asked, held


@dataclass
class ReferenceIndex:
    """References (``__r``, ``__v``, ``__chunk``) and what is needed to plan the visits of queries to their chunks."""

    cells: CellIndex
    placed: DataFrame
    margin: int
    chunk_rows: int

    @classmethod
    def of(cls, right: DataFrame, metric: str, p: float, margin: int, pivots: int | None, chunk_rows: int) -> ReferenceIndex | None:
        """None without references."""
        cells = _cell_index(right, metric, p, margin, pivots, chunk_rows)
        if cells is None:
            return None

        def to_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for start in range(0, len(rows), _BATCH):
                    part = rows.iloc[start : start + _BATCH]
                    cell, _ = cells.place(_matrix(part["__v"]))
                    yield part.assign(__chunk=cells.first_chunk[cell] + part["__h"].to_numpy() % cells.chunks[cell]).drop(columns="__h")

        chunk = T.StructField("__chunk", T.LongType())
        placed = right.withColumn("__h", F.xxhash64("__r")).mapInPandas(to_chunks, T.StructType([*right.schema.fields, chunk]))
        return cls(cells, placed, margin, chunk_rows)

    def pairs(self, left: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries (``__q``, ``__v``) and references, each with the chunks and blocks to compare."""
        cells, margin = self.cells, self.margin

        def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for start in range(0, len(rows), _BATCH):
                    part = rows.iloc[start : start + _BATCH]
                    chunks, bound = cells.visits(_matrix(part["__v"]), margin)
                    yield part.assign(__visits=chunks, __bound=bound)

        bound, visits = T.StructField("__bound", T.DoubleType()), T.StructField("__visits", T.ArrayType(T.LongType()))
        # a table that comes as one block of a file would be planned by one task
        planned = materialize(spread(left).mapInPandas(to_visits, T.StructType([*left.schema.fields, visits, bound])), "visits")
        return _copies(planned.select("__q", "__v", "__bound", F.explode("__visits").alias("__chunk")), self.placed, self.chunk_rows)


def exact_pairs(
    left: DataFrame, right: DataFrame, metric: str, p: float, margin: int, pivots: int | None, chunk_rows: int
) -> tuple[DataFrame, DataFrame] | None:
    """Queries (``__q``, ``__v``) and references (``__r``, ``__v``), each with the chunks and blocks to compare."""
    index = ReferenceIndex.of(right, metric, p, margin, pivots, chunk_rows)
    return None if index is None else index.pairs(left)


def hashed_pairs(
    left: DataFrame, right: DataFrame, tables: int, bits: int, probes: int, chunk_rows: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """The same by hashing: buckets of the signs of ``bits`` products in each of ``tables`` tables. A query visits
    ``2 ** probes`` buckets of a table, those that differ in its ``probes`` least certain signs."""

    def products(vectors: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(seed)
        return np.stack([vectors @ draw.normal(size=(vectors.shape[1], bits)) for _ in range(tables)], axis=1)

    def keys(signs: np.ndarray) -> np.ndarray:
        return (signs.astype(np.int64) << np.arange(bits)).sum(axis=-1) + (np.arange(tables, dtype=np.int64) << bits)[None, :]

    def to_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield rows.assign(__buckets=list(keys(products(_matrix(rows["__v"])) > 0)))

    def to_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                found = products(_matrix(rows["__v"]))
                unsure = np.argsort(np.abs(found), axis=2)[:, :, :probes]
                out = []
                for flips in range(1 << probes):
                    signs = found > 0
                    for i in range(probes):
                        if flips >> i & 1:
                            at = unsure[:, :, i : i + 1]
                            np.put_along_axis(signs, at, ~np.take_along_axis(signs, at, axis=2), axis=2)
                    out.append(keys(signs))
                yield rows.assign(__buckets=list(np.concatenate(out, axis=1)))

    buckets = T.StructField("__buckets", T.ArrayType(T.LongType()))
    placed = materialize(right.mapInPandas(to_buckets, T.StructType([*right.schema.fields, buckets])), "hashed").select(
        "__r", "__v", F.explode("__buckets").alias("__bucket"))
    sizes = materialize(placed.groupBy("__bucket").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("long").alias("__parts")), "bucket-sizes")
    # two chunks of one key would only be compared together
    chunk = F.xxhash64("__bucket", "__part").alias("__chunk")
    cut = placed.join(sizes, "__bucket").withColumn("__part", F.pmod(F.xxhash64("__r"), F.col("__parts"))).select("__r", "__v", chunk)
    asked = left.mapInPandas(to_probes, T.StructType([*left.schema.fields, buckets])).select("__q", "__v", F.explode("__buckets").alias("__bucket"))
    visiting = asked.join(sizes, "__bucket").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    return _copies(materialize(visiting.select("__q", "__v", chunk), "visits"), cut, chunk_rows)


def _compared(asked: DataFrame, held: DataFrame, k: int, metric: str, p: float, exclude_same_id: bool) -> DataFrame:
    """``__q``, ``__r``, ``__d``: the ``k`` nearest references of each query in each chunk it visits."""
    q_type, r_type = asked.schema["__q"].dataType.simpleString(), held.schema["__r"].dataType.simpleString()

    def compare(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return pd.DataFrame({n: [] for n in ("__q", "__r", "__d")})
        others = others.sort_values("__r", kind="stable").reset_index(drop=True)
        ids, asking = others["__r"].to_numpy(), some["__q"].to_numpy()
        own = (asking, ids) if exclude_same_id else None
        # the bound counts rows, and an id that is left out can have several
        within = None if exclude_same_id or "__bound" not in some else some["__bound"].to_numpy()
        q, r, d = nearest_places(_matrix(some["__v"]), _matrix(others["__v"]), k, metric, p, own, within)
        return pd.DataFrame({"__q": asking[q], "__r": ids[r], "__d": d})

    by = ["__chunk", "__block"]
    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(compare, f"__q {q_type}, __r {r_type}, __d double")


def _sides(queries: DataFrame, references: DataFrame, query_id: str, reference_id: str, vector: str, unit: bool) -> tuple[DataFrame, DataFrame]:
    shape = l2_normalize(F.col(vector)) if unit else F.transform(vector, lambda x: x.cast("double"))
    known = F.col(vector).isNotNull()
    return (
        queries.where(known).select(F.col(query_id).alias("__q"), shape.alias("__v")),
        references.where(known).select(F.col(reference_id).alias("__r"), shape.alias("__v")),
    )


def first_copies(references: DataFrame, k: int, exclude_same_id: bool) -> DataFrame:
    """Of equal vectors the ``k`` rows with the smallest ids; where a query leaves out its own id, the rows of the first
    ``k + 1`` ids. No other copy can be among the ``k`` nearest of any query."""
    copies = Window.partitionBy(F.xxhash64("__v"), "__v").orderBy(F.col("__r").asc_nulls_last())
    place, last = (F.dense_rank(), k + 1) if exclude_same_id else (F.row_number(), k)
    return references.withColumn("__place", place.over(copies)).where(F.col("__place") <= last).drop("__place")


def stored_references(references: DataFrame, k: int, metric: str = "euclidean", p: float = 2.0, chunk_rows: int = 1 << 14) -> ReferenceIndex | None:
    """References (``__r``, ``__v``, finite numbers) placed once, to be asked again and again by ``first_of``."""
    held = materialize(first_copies(references, k, False), "first-copies")
    index = ReferenceIndex.of(held, metric, p, k, None, chunk_rows)
    return None if index is None else replace(index, placed=materialize(index.placed, "placed"))


def first_of(asked: DataFrame, index: ReferenceIndex, k: int) -> DataFrame:
    """``__q``, ``__r``, ``__d``: the ``k`` nearest of stored references for each query (``__q``, ``__v``)."""
    found = _compared(*index.pairs(asked), k, index.cells.metric, index.cells.p, False)
    return _first(found, k)


def _first(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("__place", F.row_number().over(Window.partitionBy("__q").orderBy("__d", "__r"))).where(F.col("__place") <= k).drop("__place")


def _ranked(survivors: DataFrame, k: int, query_id: str, reference_id: str, unit: bool) -> DataFrame:
    ranking = Window.partitionBy("__q").orderBy("__d", "__r")
    out = (
        survivors.withColumn("rank", F.row_number().over(ranking))
        .where(F.col("rank") <= k)
        .select(F.col("__q").alias(query_id), F.col("__r").alias(reference_id), F.col("__d").alias("distance"), "rank")
    )
    return out.withColumn("similarity", 1.0 - F.col("distance") * F.col("distance") / 2.0) if unit else out


def nearest(
    queries: DataFrame,
    references: DataFrame,
    k: int,
    metric: str = "euclidean",
    query_id: str = "query_id",
    reference_id: str = "reference_id",
    vector: str = "embedding",
    exclude_same_id: bool = False,
    p: float = 2.0,
    pivots: int | None = None,
    chunk_rows: int = 1 << 14,
) -> DataFrame:
    """(query_id, reference_id, distance, rank) for the ``k`` nearest references of each query.

    Ties go to the smaller reference id. ``cosine`` ranks by the distance of the normalised
    vectors and also returns ``similarity``.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    unit = metric == "cosine"
    left, right = _sides(queries, references, query_id, reference_id, vector, unit)
    # a row with a number that is not finite meets nothing
    left, right = (side.where(F.forall("__v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))) for side in (left, right))
    right = materialize(first_copies(right, k, exclude_same_id), "first-copies")
    asked = left
    if not exclude_same_id:  # equal queries have the same neighbours, so one of them is compared
        asked = materialize(left.select("__v").distinct().withColumn("__q", F.monotonically_increasing_id()), "asked").select("__q", "__v")
    # one more than k, because a query may meet itself among the references
    pairs = exact_pairs(asked, right, metric, p, k + (1 if exclude_same_id else 0), pivots, chunk_rows)
    if pairs is None:
        names = f"__q {left.schema['__q'].dataType.simpleString()}, __r {right.schema['__r'].dataType.simpleString()}, __d double"
        return _ranked(queries.sparkSession.createDataFrame([], names), k, query_id, reference_id, unit)
    found = _compared(*pairs, k, metric, p, exclude_same_id)
    if not exclude_same_id:
        first = _first(found, k)
        of = left.join(asked.withColumnRenamed("__q", "__asked"), "__v").select("__q", "__asked")
        found = of.join(first.select(F.col("__q").alias("__asked"), "__r", "__d"), "__asked").select("__q", "__r", "__d")
    return _ranked(found, k, query_id, reference_id, unit)


def nearest_hashed(
    queries: DataFrame,
    references: DataFrame,
    k: int,
    query_id: str = "query_id",
    reference_id: str = "reference_id",
    vector: str = "embedding",
    exclude_same_id: bool = False,
    tables: int = 12,
    bits: int = 8,
    probes: int = 3,
    chunk_rows: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """The same columns as ``nearest`` by cosine, from candidates by hashing: not exact, ``recall`` tells how near.

    All references are indexed. More tables and probes find more, more bits compare less; vectors without near
    neighbours (similarities below one half) need few bits.
    """
    left, right = _sides(queries, references, query_id, reference_id, vector, True)
    asked, held = hashed_pairs(left, right, tables, bits, probes, chunk_rows, seed)
    # a pair can meet in several tables
    met = _compared(asked, held, k, "cosine", 2.0, exclude_same_id).groupBy("__q", "__r").agg(F.min("__d").alias("__d"))
    return _ranked(met, k, query_id, reference_id, True)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", reference_id: str = "reference_id") -> float:
    """Share of the exact neighbours that were found."""
    both = exact.select(query_id, reference_id).join(found.select(query_id, reference_id).distinct(), [query_id, reference_id]).count()
    return both / max(1, exact.count())


def neighbour_vote(neighbours: DataFrame, references: DataFrame, label: str, query_id: str = "query_id", reference_id: str = "reference_id") -> DataFrame:
    """Majority label of each query's neighbours and its share; ties go to the smallest label."""
    votes = (
        neighbours.join(references.select(reference_id, label), reference_id)
        .groupBy(query_id, label)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return votes.groupBy(query_id).agg(
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("prediction"),
        (F.max("n") / F.sum("n")).alias("share"),
    )
