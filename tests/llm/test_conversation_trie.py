"""The conversation trie against brute force, and the radix tree against plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from flowtide.llm import conversation_trie
from flowtide.llm.conversation_trie import SQL, conversation_trie as trie
from flowtide.llm.radix_tree import Direct, Held, Indexed, RadixTree, Sorted, prefixes

SCHEMA = "conv_id long, turn long, role string, text string, id string, words string, node string, part string, lender string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    """Nodes by definition: every prefix of every rebuilt conversation."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append(((turn is not None, turn or 0), digest(role or "", text or ""), role or "", text or ""))
    seqs = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(seqs.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = {}
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        leaves = sum(not any(len(k) > len(u) and k[: len(u)] == u for k in below) for u in below)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(key))
        out[(min(convs), len(key))] = (
            min(members[key[:-1]]) if key else None, len(convs), sum(len(k) == len(key) + 1 for k in below), leaves, saved,
            hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {r[:2]: r[2:] for r in rows}


def make(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def mixed_rows():
    """Shared first turns, copies, ties, nulls, repeated rows, a long text, a long conversation, absent family heads."""
    draw, rows = random.Random(3), []
    for c in range(140):
        for turn in range(draw.choice([1, 2, 3, 4, 6])):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["yes", "no", "tell me  more", "", "a b c d"])))
    for c in range(200, 300):
        rows += [(c, t, "user", f"same {t}") for t in range(3)]
    rows += [(301, None, "user", "first"), (301, 5, None, "tied"), (301, 5, "user", None), (301, 5, "user", None)]
    rows += [(None, 0, "user", "lost"), (302, 0, "", "word " * 50_000), (303, 0, "user", "one")]
    rows += [(10**12 + 7, 0, "user", "same 0"), (340, 0, "user", "same 0")]
    return rows


@pytest.mark.parametrize("block", [20_000, 1, 7])
def test_against_brute_force(spark, mixed_rows, block, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    assert found(trie(make(spark, mixed_rows))) == brute(mixed_rows)


def test_long_conversations(spark):
    own = [c for c in range(400, 500) if zlib.crc32(str(c).encode()) % 4 == 0][:2]  # these borrow nothing
    rows = [(c, t, "user", f"turn {t % 3}") for c, n in zip(own, (1500, 1400)) for t in range(n)] + [(own[0] - 1000, 0, "user", "one")]
    got = found(trie(make(spark, rows)))
    assert max(d for _, d in got) == 1500
    assert got[(own[0], 1400)][1:4] == (2, 1, 1)
    assert got[(own[0], 1)][3:5] == (1, 2 * 1400)


def test_empty_and_unnamed(spark):
    assert trie(make(spark, [(1, 0, "user", "x")]).where("false")).count() == 0
    assert trie(make(spark, [(None, 0, "user", "x")])).count() == 0


def test_turnless_conversation_ends_at_the_root(spark):
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 1)
    got = found(trie(make(spark, [(lone, 0, "user", "x")])))
    assert got == {(lone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}


def test_against_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    expected = {r[:2]: r[2:] for r in con.sql(f"SELECT {', '.join(names)} FROM ({SQL})").fetchall()}
    docs = spark.read.parquet(f"{small}/conversations.parquet")
    assert found(trie(docs)) == expected == brute([tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()])


def test_radix_tree_is_a_dictionary_and_grows():
    draw, tree, plain = random.Random(5), RadixTree(), {}
    for n in range(6000):
        key = bytes(draw.choice([draw.randrange(256), 1, 2]) for _ in range(2 * draw.randrange(0, 6)))
        tree.insert(key, n)
        plain[key] = n
    assert all(tree.get(k) == v for k, v in plain.items())
    assert tree.get(b"\x01\x02" * 40) is None
    kinds, nodes = set(), [tree.root]
    while nodes:
        node = nodes.pop()
        kinds.add((type(node.children), node.children.room))
        below = list(node.children.items())
        assert [b for b, _ in below] == sorted(b for b, _ in below)
        assert node is tree.root or len(node.path) >= 1
        nodes += [n for _, n in below]
    assert kinds == {(Sorted, 4), (Sorted, 16), (Indexed, 48), (Direct, 256)}


def test_only_whole_units_are_prefixes():
    tree = RadixTree()
    for i, key in enumerate([b"aabb", b"aabc", b"aa", b"ad", b"aabbcc"]):
        tree.insert(key, Held([i], [1, 10, 100][: len(key) // 2]))
    found = {(p.depth, p.first): (p.members, p.children, p.leaves, p.weighed, p.weight, p.ends) for p in prefixes(tree, 2)}
    assert found == {
        (0, 0): (5, 2, 3, 4 + 1 + 30 + 100, 1 + 1 + 20 + 100, []),
        (1, 0): (4, 2, 2, 4 + 30 + 100, 1 + 20 + 100, [2]),
        (1, 3): (1, 0, 1, 1, 1, [3]),
        (2, 0): (2, 1, 1, 20 + 100, 110, [0]),
        (2, 1): (1, 0, 1, 10, 10, [1]),
        (3, 4): (1, 0, 1, 100, 100, [4]),
    }
