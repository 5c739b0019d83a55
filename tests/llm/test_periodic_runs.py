"""Runs by synchronising sets against the definition."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from flowtide.llm import periodic_runs
from flowtide.llm.periodic_runs import runs


def brute(words, least=12):
    """Every run by its definition: for every period the stretches where words agree."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def of_block(texts):
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    start, end, period = runs([np.array(texts[i], np.int64) for i in order])
    out, at = [[] for _ in texts], 0
    for i in order:
        for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
            if at <= s < at + len(texts[i]):
                out[i].append((s - at, e - at, q))
        at += len(texts[i]) + 1
    return [sorted(o) for o in out]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples():
    draw = random.Random(11)
    out = [[], [0], [0] * 11, [0] * 12, [0] * 500, fibonacci(610), [bin(i).count("1") % 2 for i in range(512)], list(range(300))]
    for n in (13, 40, 100, 257, 600):
        for letters in (1, 2, 3, 50):
            out.append([draw.randrange(letters) for _ in range(n)])
    for _ in range(60):  # repeats of repeats with breaks
        text = [draw.randrange(4) for _ in range(draw.randrange(1, 8))]
        while len(text) < 400:
            text = text * draw.randrange(1, 5) + text[: draw.randrange(0, len(text) + 1)] + [draw.randrange(4)] * draw.randrange(0, 3)
        out.append(text[: draw.randrange(380, 700)])
    for p, k, cut in ((2, 50, 1), (3, 40, 2), (5, 60, 3), (7, 30, 1), (17, 20, 5)):  # halves of a small period that does not divide the large one
        half = list(range(p)) * k + list(range(cut))
        out += [half * 2, half * 3 + half[:5], [99, *half, *half, 98], half + half[:-3]]
    for q in (12, 23, 24, 95, 96, 97, 300):  # borders of the scales
        base = [draw.randrange(1000) for _ in range(q)]
        out += [base * 2, [5000, *base, *base], base * 2 + base[:-1], base + base[: q - 1], [7777, *(base * 3), 8888]]
    return out


def test_against_the_definition():
    texts = samples()
    got = of_block(texts)
    for text, found in zip(texts, got):
        assert found == brute(text), (len(text), text[:40])
    assert sum(map(len, got)) > 500
    assert any(q > 100 for found in got for _, _, q in found)


@pytest.mark.parametrize("seed", range(6))
def test_random_repeats(seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(40):
        text = []
        while len(text) < draw.randrange(30, 900):
            if text and draw.random() < 0.6:
                p = draw.randrange(1, len(text) + 1)
                text += [text[len(text) - p + i % p] for i in range(draw.randrange(1, 2 * p + 2))]
            else:
                text += [draw.randrange(6) for _ in range(draw.randrange(1, 20))]
        texts.append(text[:1200])
    assert of_block(texts) == [brute(t) for t in texts]


def test_colliding_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mixed", lambda x: x & np.uint64(7))
    texts = samples()[20:60]
    assert of_block(texts) == [brute(t) for t in texts]


def as_query(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    return (len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = entry.queries()["op11_periodic_runs"](spark, small).collect()
    assert len(rows) == len(docs)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in rows}
    short = [d for d in docs if len((d["text"] or "").split()) <= 1500]
    assert len(short) > 0.9 * len(docs)
    for d in short:
        assert got[d["doc_id"]] == as_query(d["doc_id"], d["text"]), d["doc_id"]
    assert sum(g[0] for g in got.values()) > 10


def test_edges(edge, edge_rows, nothing):
    rows = periodic_runs.periodic_runs(edge).collect()
    assert len(rows) == len(edge_rows)
    plain = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for i in (5, 6, 7):
        assert plain[i]["runs"] == [] and plain[i]["collapsed"] == ""
    assert plain[9]["collapsed"] == "one"
    assert plain[1]["runs"] == plain[2]["runs"]
    assert periodic_runs.periodic_runs(nothing).count() == 0


def test_a_very_long_text(spark):
    words = [f"w{i % 977}" for i in range(200_000)]
    words[100_000] = "break"
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 100_000, 977), (100_001, 99_999, 977)]
    assert len(row["collapsed"].split()) == 2 * 977 + 1
