"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are normalised to lower-cased words with one space between, scanned once, and hits are mapped back
to word numbers and to code points of the text as it was. The driver reads the benchmark in parts of a
bounded number of windows, one automaton each; with one part, the usual case, a worker builds its automaton
once and keeps it. More parts are built one after the other for each batch, so memory stays that of one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Windows in one automaton; it takes about 3 KB for each.
MAX_WINDOWS = 40_000
#: Every byte that is not part of a word becomes a space, A-Z become lower case.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
RESULT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long>>>"

_kept: dict[str, ahocorasick.Automaton] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """The windows of an item, each as words with a space around; a shorter item is one window."""
    if not words:
        return set()
    last = max(1, len(words) - size + 1)
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(last)}


def _automaton(windows: dict[bytes, list[str]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for window, items in windows.items():
        found.add_word(window.decode("latin-1"), (window.count(b" ") - 1, items))
    found.make_automaton()
    return found


def benchmark_parts(benchmark: DataFrame, size: int = WINDOW, most: int = MAX_WINDOWS) -> Iterator[dict[bytes, list[str]]]:
    """Windows with the ids of their items, in parts. An item without words has none; one without id has
    windows but is not listed."""
    # a word takes a byte at least, and a separator
    bound = benchmark.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    parts = max(1, int(-(-bound // (3 * most))))
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull())
    for part in range(parts):
        windows: dict[bytes, list[str]] = {}
        for row in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toLocalIterator():
            for window in windows_of(words_of(bytes(row["text"])), size):
                ids = windows.setdefault(window, [])
                if row["item_id"] is not None:
                    ids.append(str(row["item_id"]))
        yield windows


def _marks(text: str, spaces: np.ndarray, automaton: ahocorasick.Automaton, depth: np.ndarray, items: set[str]) -> None:
    """Open and close every hit in ``depth``, word by word."""
    for end, (length, ids) in automaton.iter(text):
        last = int(np.searchsorted(spaces, end))
        depth[last - length] += 1
        depth[last] -= 1
        items.update(ids)


def _spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code points of the text, end exclusive."""
    bounds = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [
        {"start": int(points[bounds[a][0]]), "end": int(points[bounds[b - 1][1]])}
        for a, b in zip(edges[::2], edges[1::2])
    ]


def scanner(benchmark: DataFrame, size: int = WINDOW, most: int = MAX_WINDOWS):
    """A function of a text column: words, hit words, ids of the items that occur, spans of the hits."""
    context = benchmark.sparkSession.sparkContext
    shared = [context.broadcast(part) for part in benchmark_parts(benchmark, size, most)]
    name = uuid.uuid4().hex

    def automata() -> Iterator[ahocorasick.Automaton]:
        for part in shared:
            if len(shared) > 1:
                yield _automaton(part.value)
            else:
                if name not in _kept:
                    _kept.clear()
                    _kept[name] = _automaton(part.value)
                yield _kept[name]

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        lines = []
        for text in texts:
            words = words_of(text.as_py() or b"")
            lines.append((b" " + b" ".join(words) + b" " if words else b"", np.zeros(len(words) + 1, np.int32), set()))
        for automaton in automata():
            if not len(automaton):
                continue
            for line, depth, items in lines:
                normal = line.decode("latin-1")
                if next(automaton.iter(normal), None) is not None:
                    _marks(normal, np.flatnonzero(np.frombuffer(line, np.uint8) == 32), automaton, depth, items)
        out = []
        for text, (_, depth, items) in zip(texts, lines):
            hit = np.cumsum(depth[:-1]) > 0
            n_hit = int(hit.sum())
            spans = _spans(text.as_py(), hit) if n_hit else []
            out.append({"n_words": len(hit), "n_hit": n_hit, "items": sorted(items), "spans": spans})
        fields = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        return pa.array(out, pa.struct(fields))

    def apply(text: Column) -> Column:
        return scan(text.cast("binary"))

    return apply


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans, contaminated.

    A null or empty text has no words and is clean; repeated rows are scanned one by one; an empty table of
    documents gives an empty result, an empty benchmark no hits; columns other than doc_id and text
    are left out.
    """
    scan = scanner(benchmark, size)
    found = docs.select("doc_id", scan(F.col("text")).alias("hit"))
    return found.select(
        "doc_id", "hit.n_words", "hit.n_hit", "hit.items", "hit.spans", (F.col("hit.n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns."""
    scan = scanner(benchmark, size)
    return docs.where(scan(F.col("text")).getField("n_hit") == 0)


#: The same digest over whole tables, by joins of word windows.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS line
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS line
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT rid, item_id, size, i FROM places JOIN windows USING (size, line)),
words AS (
  SELECT rid, count(DISTINCT word) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + size)) AS word FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
