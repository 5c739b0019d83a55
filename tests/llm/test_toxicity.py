"""The recurrent network: gradients against differences, windows, held-out accuracy, and the defined cases."""

from __future__ import annotations

import pickle
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from flowtide.llm import attention_gru as gru
from flowtide.llm import toxicity


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(gru, "F32", np.float64)
    monkeypatch.setattr(gru, "PIECE_BITS", 6)
    words = [b"a", b"bb", b"ccc", b"dddd", b"eeeee"]
    codes, starts = gru.pieces(words)
    weights = {k: v.astype(np.float64) for k, v in gru.initial(3, 1).items()}
    places = np.array([0, 1, 2, 3, 0])
    draw = np.random.default_rng(2)
    ids = draw.integers(0, 5, (4, 6))
    mask = (np.arange(6) < np.array([[6], [1], [4], [5]])).astype(np.float64)
    target, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    args = (ids, mask, places, codes, starts, target, weight)

    def loss():
        return gru.loss_and_gradients(weights, *args)[0]

    _, grads = gru.loss_and_gradients(weights, *args)
    assert set(grads) == set(weights)
    for name, grad in grads.items():
        flat = weights[name].reshape(-1)
        for i in draw.choice(len(flat), min(20, len(flat)), replace=False):
            if name == "words" and i < gru.INPUT:
                continue  # words outside the vocabulary keep a vector of zeros
            held = flat[i]
            flat[i] = held + 1e-5
            up = loss()
            flat[i] = held - 1e-5
            down = loss()
            flat[i] = held
            assert np.isclose(grad.reshape(-1)[i], (up - down) / 2e-5, atol=2e-6), name


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 56, 57, 1000, 1003])
def test_windows_cover_and_overlap(n):
    start, size, first = gru.windows_of(np.array([n, 5, n]))
    assert list(first) == [0, len(start) // 2 - (len(start) - 1) % 2, len(start) // 2 + len(start) % 2] or n <= 32
    own = [(s, s + z) for s, z in zip(start[: first[1]], size[: first[1]])]
    assert own[0][0] == 0 and own[-1][1] == n
    for (_, e), (s, _) in zip(own, own[1:]):
        assert s < e
    assert start[-1] + size[-1] == 2 * n + 5


def test_pieces_do_not_cross_words():
    codes, starts = gru.pieces([b"abc", b"x", "ÄÖ".encode()])
    alone, _ = gru.pieces([b"x"])
    assert list(codes[starts[1] : starts[2]]) == list(alone)
    assert list(starts) == [0, 6, 8]


def lines(n, seed):
    draw = random.Random(seed)
    plain = ["".join(draw.choice("aeioustrnlm") for _ in range(draw.randrange(2, 8))) for _ in range(300)]
    texts, marks = [], []
    for i in range(n):
        ws = [draw.choice(plain) for _ in range(draw.randrange(5, 200))]
        if i % 4 == 0:
            for _ in range(3):
                ws.insert(draw.randrange(len(ws)), "vegq" + draw.choice(plain))  # the start of the word tells, its end is new
        texts.append(" ".join(ws))
        marks.append(int(i % 4 == 0))
    return texts, marks


@pytest.fixture(scope="module")
def network():
    texts, marks = lines(500, 1)
    return gru.train(texts, marks, [1.0] * len(texts))


def test_new_words_are_known_by_their_characters(network):
    texts, marks = lines(300, 2)
    scores = network.scores(texts)
    assert np.mean((scores >= 0.7) == np.array(marks)) > 0.97


def test_scores_do_not_depend_on_the_batch(network):
    texts = [*lines(40, 3)[0], "", None, "! ? .", "x", " ".join(lines(1, 4)[0] * 400)]
    together = network.scores(texts)
    fresh = pickle.loads(pickle.dumps(network))
    alone = np.array([fresh.scores([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert together[40] == together[41] == together[42] and 0 <= together.min() and together.max() <= 1
    assert len(network.scores([])) == 0


def test_the_worst_window_counts(network):
    plain = " ".join(lines(2, 5)[0][1:] * 60)
    words = plain.split()
    words[len(words) // 2 : len(words) // 2] = ["vegqab", "vegqoo", "vegqer"]
    assert network.scores([plain])[0] < 0.5 < 0.7 <= network.scores([" ".join(words)])[0]


def test_training_is_repeatable():
    texts, marks = lines(60, 6)
    one, two = (gru.train(texts, marks, [1.0] * 60, epochs=2) for _ in range(2))
    assert np.array_equal(one.scores(texts), two.scores(texts))
    assert gru.train(["", " "], [1, 0], [1.0, 1.0]) is None


def test_query_on_held_out_rows(spark, small):
    rows = entry.queries()["op12_toxicity_gru"](spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_edges(spark, edge, edge_rows, nothing):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (4, 0), (3, None), (None, 1), (99, 1), (8, 7), (10, 0), (12, 0), (13, 0), (14, 0)], "doc_id long, toxic long")
    rows = toxicity.toxicity(edge, labels).collect()
    assert len(rows) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["score"] == by_id[6]["score"] == by_id[7]["score"]
    assert by_id[1]["score"] == by_id[2]["score"] == by_id[None]["score"]
    assert by_id[None]["held_out"] is False
    assert toxicity.toxicity(nothing, labels).count() == 0
    none = toxicity.toxicity(edge, labels.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}


def test_held_out_rows_teach_nothing(spark, edge):
    out = [i for i in range(1, 15) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = spark.createDataFrame([(i, i % 2) for i in out], "doc_id long, toxic long")
    assert toxicity.sample(edge, labels) == []
