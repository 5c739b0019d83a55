"""Maximal periodic runs of words, by string synchronising sets.

Texts are cut into words, numbered, and searched a block of texts at a time; the blocks are independent, so the
work is one pass without a shuffle.

* Periods below ``SMALL`` are found directly: stretches where a word equals the one a period before.
* At scale t (4, 8, 16, ...) periods from 3t to 6t - 1 are proposed. A position is in the synchronising set if,
  among the hashes of the t + 1 windows of t words from there on, the smallest is the first or the last; windows
  of a period of t / 3 or less do not count. So it depends on its context of 2t words alone, and of t
  neighbouring positions one is in the set unless 3t - 1 words there have a period of t / 3 or less. A run of
  period q has q - 2t + 1 > t positions whose contexts lie inside it and occur again q words later: if one of
  them is in the set, the pair of equal contexts proposes q. Equal contexts are more than t / 3 apart, so a
  position has few partners below 6t.
* If none is in the set, each half of the run is part of a region of a small period, known from the scales
  before: two neighbouring regions of one root propose the distances that bring the root into step.

Proposals are extended as far as words agree by comparing hashes of dyadic windows, and what is found is
compared word by word; should two hashes have collided, that period is searched directly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.sketches import mixed

#: A run has so many words and two periods at least.
LEAST = 12
#: Periods below are searched directly; the first scale takes over there.
SMALL, FIRST_SCALE = 12, 4
#: Windows of up to 2 ** this many words keep their hashes for extensions.
LEVELS = 8
#: Words that are searched at a time; a longer text is a block of its own, at about 150 bytes a word.
BLOCK = 1 << 19

RUN = "struct<start:long,length:long,period:long>"
_NONE, _ODD = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)
Regions = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end, period

#: Changes the words of a document before they are searched.
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def stretches(words: np.ndarray, period: int, least: int) -> Regions:
    """The maximal stretches of at least ``least`` words where each equals the one a period before."""
    breaks = np.flatnonzero(words[:-period] != words[period:])
    bounds = np.concatenate(([-1], breaks, [max(0, len(words) - period)]))
    long = np.flatnonzero(np.diff(bounds) - 1 + period >= max(least, period + 1))
    start, end = bounds[long] + 1, bounds[long + 1] + period
    return start, end, np.full(len(start), period)


def _joined(parts: list[Regions]) -> Regions:
    if not parts:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))


def _smallest(regions: Regions) -> Regions:
    """One region for each start and end, with the smallest period, by start and period."""
    start, end, period = regions
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _extended(levels: list[np.ndarray], at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far, to the left and right of each place, words agree with those ``apart`` later: start, and end
    with the last period."""
    left, right = at.copy(), at.copy()
    for level in range(len(levels) - 1, -1, -1):
        hashes, step = levels[level], 1 << level
        going = np.arange(len(at))
        while len(going):
            x, y = right[going], right[going] + apart[going]
            inside = y < len(hashes)
            same = np.zeros(len(going), bool)
            same[inside] = hashes[x[inside]] == hashes[y[inside]]
            going = going[same]
            right[going] += step
        going = np.arange(len(at))
        while len(going):
            x = left[going] - step
            y = x + apart[going]
            inside = (x >= 0) & (y < len(hashes))
            same = np.zeros(len(going), bool)
            same[inside] = hashes[x[inside]] == hashes[y[inside]]
            going = going[same]
            left[going] -= step
    return left, right + apart


def _doubled(hashes: np.ndarray, step: int) -> np.ndarray:
    """Hashes of windows twice as long."""
    if len(hashes) <= step:
        return np.empty(0, np.uint64)
    return mixed(hashes[:-step] * _ODD + hashes[step:])


def _synchronising(hashes: np.ndarray, scale: int, periodic: Regions) -> np.ndarray:
    """The positions of the synchronising set, without windows inside the ``periodic`` regions."""
    ids = hashes.copy()
    start, end, _ = periodic
    if len(start):
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, end - scale + 1, -1)
        ids[np.cumsum(change[:-1]) > 0] = _NONE
    least, step = ids, 1
    while step < scale:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if len(least) < 2:
        return np.empty(0, np.int64)
    least = np.minimum(least[:-1], least[1:])
    n = len(least)
    return np.flatnonzero((least != _NONE) & ((least == ids[:n]) | (least == ids[scale : scale + n])))


def _pairs(places: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with an equal context 3 to 6 scales later, and how much later."""
    order = np.argsort(contexts, kind="stable")
    places, contexts = places[order], contexts[order]
    at, apart = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    further = 1
    while further < len(places):
        gap = places[further:] - places[:-further]
        near = (contexts[further:] == contexts[:-further]) & (gap < 6 * scale)
        if not near.any():
            break
        taken = np.flatnonzero(near & (gap >= 3 * scale))
        at.append(places[taken])
        apart.append(gap[taken])
        further += 1
    return np.concatenate(at), np.concatenate(apart)


def _in_step(regions: Regions, levels: list[np.ndarray], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of 3 to 6 scales that bring two neighbouring regions of one root into step."""
    start, end, period = regions
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    over = end[:-1] - start[1:]
    at, apart = [], []
    for i in np.flatnonzero((period[:-1] == period[1:]) & (over >= 0) & (over < period[:-1])):
        a, e, b, f, p = int(start[i]), int(end[i]), int(start[i + 1]), int(end[i + 1]), int(period[i])
        level = min(p.bit_length() - 1, len(levels) - 1)
        root = levels[level]
        for phase in np.flatnonzero(root[a : a + p] == root[b]):
            first = b - a - int(phase)
            distances = np.arange(first - (first // p) * p, min(f - b, e - a) + 1, p)
            distances = distances[(distances >= 3 * scale) & (distances < 6 * scale)]
            apart.append(distances)
            at.append(np.maximum(a, b - distances))
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(at), np.concatenate(apart)


def _exact(words: np.ndarray, start: int, end: int, period: int) -> bool:
    return (
        bool((words[start : end - period] == words[start + period : end]).all())
        and (start == 0 or words[start - 1] != words[start - 1 + period])
        and (end == len(words) or words[end] != words[end - period])
    )


def runs(texts: list[np.ndarray]) -> Regions:
    """All runs of a block: start, end and smallest period, by start and period, where the texts, numbers of
    words from 0 on, stand behind each other with one place between them, the longest first."""
    if not texts:
        return _joined([])
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1)  # the place behind a text holds a number of its own
    words = np.empty(int(ends[-1]), np.int64)
    for i, text in enumerate(texts):
        words[ends[i] - 1 - len(text) : ends[i] - 1] = text
        words[ends[i] - 1] = -1 - i

    regions, found = [], []
    for period in range(1, SMALL):
        least = max(LEAST, 2 * period)
        start, end, of = stretches(words, period, min(least, max(3 * period, FIRST_SCALE)))
        regions.append((start, end, of))
        long = end - start >= least
        found.append((start[long], end[long], of[long]))
    known = _smallest(_joined(regions))

    hashes = mixed(words.astype(np.uint64))
    levels, step, scale, twice = [hashes], 1, FIRST_SCALE, None
    while True:
        many = int(np.searchsorted(-lengths, -6 * scale, "right"))  # texts that can hold two periods of 3 scales
        if not many:
            break
        while step < scale:  # windows of one scale, for the texts that are still searched
            hashes, step, twice = _doubled(hashes, step) if twice is None else twice, 2 * step, None
            if len(levels) <= LEVELS:
                levels.append(hashes)
        active = int(ends[many - 1])
        hashes = hashes[: max(0, active - step + 1)]
        small = (known[2] * 3 <= scale) & (known[1] - known[0] >= scale) & (known[1] <= active)
        periodic = tuple(x[small] for x in known)
        places, twice = _synchronising(hashes, scale, periodic), _doubled(hashes, step)
        at, apart = _pairs(places, twice[places], scale)
        long = periodic[1] - periodic[0] >= 3 * scale
        more_at, more_apart = _in_step(tuple(x[long] for x in periodic), levels, scale)
        at, apart = np.concatenate((at, more_at)), np.concatenate((apart, more_apart))
        if len(at):
            start, end = _extended(levels, at, apart)
            long = end - start >= 2 * apart
            proposed = np.unique(np.stack((start[long], end[long], apart[long]), axis=1), axis=0)
            right = np.array([_exact(words, *row) for row in proposed.tolist()], bool)
            new = [tuple(proposed[right].T)]
            for period in np.unique(proposed[~right, 2]):  # two hashes have collided
                new.append(stretches(words, int(period), 2 * int(period)))
            found += new
            known = _smallest(_joined([known, *new]))
        scale *= 2
    return _smallest(_joined(found))


def numbered(words: list[list[bytes]]) -> list[np.ndarray]:
    """The words of several texts as numbers, equal for equal words."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return [np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws)) for ws in words]


def _collapsed(words: list[bytes], start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bytes:
    """The text without the words of its runs after their first periods."""
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def _searched(words: list[list[bytes]]) -> list[tuple[list[dict], bytes]]:
    """Runs and collapsed text of each text of a block."""
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    start, end, period = runs(numbered([words[i] for i in order]))
    at, out = 0, [None] * len(words)
    low = 0
    for i in order:
        high = low + int(np.searchsorted(start[low:], at + len(words[i]), "left"))
        s, e, p = start[low:high] - at, end[low:high] - at, period[low:high]
        listed = [{"start": a, "length": b - a, "period": q} for a, b, q in zip(s.tolist(), e.tolist(), p.tolist())]
        out[i] = listed, _collapsed(words[i], s, e, p)
        low, at = high, at + len(words[i]) + 1
    return out


def _blocks(batch: pa.RecordBatch, rewrite: Rewrite | None) -> Iterator[tuple[list, list[list[bytes]]]]:
    """doc_ids and words, texts of about one length together."""
    sizes = np.array([t.as_buffer().size if t.is_valid else 0 for t in batch.column(1)])
    ids, block, n = [], [], 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i]
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []
        ids.append(doc_id)
        block.append(rewrite(doc_id, words) if rewrite else words)
        n += len(words) + 1
        if n >= BLOCK:
            yield ids, block
            ids, block, n = [], [], 0
    if ids:
        yield ids, block


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period, by start and period) and ``collapsed``, the words
    without what runs repeat, joined by one space.

    Words stand between ASCII white space. A null, empty or blank text has no runs and collapses to the empty
    text. Rows are searched one by one, so repeated rows and rows without doc_id give equal results; a very long
    text is searched whole; an empty table gives an empty result; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for ids, words in _blocks(batch, rewrite):
                found = _searched(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.binary()).cast(pa.string())],
                    ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, runs array<{RUN}>, collapsed string")


def listed(found: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.array_join(F.transform(found, lambda r: F.concat(line(r), F.lit("\n"))), "")


def longest(found: Column) -> Column:
    """A struct of the run of greatest length, then smallest start, then smallest period; null without a run."""
    least = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(found) > 0, F.struct(least["start"].alias("start"), (-least["shorter"]).alias("length"), least["period"].alias("period")))
