"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn is the first 128 bits of a digest of its role and text, and its words; after the first pass only these
travel. A conversation is the row of its turn ids, and the rows are dealt out by range of (turn ids, conv_id),
so that every task has the same number of them, however many share a first turn or are copies of each other.
A task builds one tree after the other over at most ``BLOCK`` sorted conversations and writes the prefix nodes
of each with the sums of its part of the subtree: a whole node for most, a part for those that lie on the
border of two trees. All sums add up over the parts, but for what two neighbouring trees both count: the
prefixes that the last key of one shares with the first key of the next, and the last key if it is no leaf.
Corrections for these are added as rows, and one aggregate by node gives the whole trie.

The digest of the members that end at a node is a chain over their ids in order. A task has them as one text
for each of its trees; the few keys that lie on a border are put together by streaming these texts in order.

A conversation is one record of 24 bytes a turn; nothing else is held together. The borders between tasks are
one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import TOKEN
from flowtide.llm.radix_tree import ROOT, Held, RadixTree, prefixes, unit_id
from flowtide.session import materialize

#: Bytes of a turn id; conversations in one tree.
WIDTH, BLOCK = 16, 20_000
#: Rows are written in batches of this many.
BATCH = 8192
#: Conversations of one family borrow their first turns from its first member.
FAMILY, MOST_BORROWED = 20, 3

_NODE, _ENDS, _BORDER = 0, 1, 2
_FIELDS = [
    ("kind", pa.int32(), "int"), ("node", pa.binary(), "binary"), ("parent", pa.binary(), "binary"), ("depth", pa.int64(), "long"),
    ("conv_id", pa.int64(), "long"), ("n_convs", pa.int64(), "long"), ("n_children", pa.int64(), "long"), ("n_leaves", pa.int64(), "long"),
    ("weighed", pa.int64(), "long"), ("weight", pa.int64(), "long"), ("ends", pa.string(), "string"), ("part", pa.int32(), "int"),
    ("block", pa.int32(), "int"), ("first", pa.binary(), "binary"), ("last", pa.binary(), "binary"), ("words", pa.list_(pa.int64()), "array<long>"),
]
_SCHEMA = ", ".join(f"{name} {kind}" for name, _, kind in _FIELDS)
_ARROW = pa.schema([(name, kind) for name, kind, _ in _FIELDS])


def borrowed(conv_id: Column) -> Column:
    """How many of its first turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_BORROWED + 1)).cast("int")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), id and words of every turn. A null turn comes first; turns of one number are in
    the order of their ids; a null role or text is empty. Rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    said = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.unhex(F.substring(digest, 1, 2 * WIDTH)).alias("id"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    return said.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "id", "words")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of structs of id and words: the first turns of the first conversation of
    the family, as many as ``borrowed`` says, and its own after as many."""
    own = materialize(turns(conversations), "turns")
    turn = F.struct("place", "id", "words")
    lent = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < MOST_BORROWED)).select(F.col("conv_id").alias("lender"), turn.alias("turn"))
    takes = own.where((F.col("place") == 0) & (borrowed(F.col("conv_id")) > 0)).select(
        "conv_id", borrowed(F.col("conv_id")).alias("n"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("lender"))
    taken = takes.join(lent, "lender").where(F.col("turn.place") < F.col("n")).select("conv_id", "turn")
    kept = own.select("conv_id", F.when(F.col("place") >= borrowed(F.col("conv_id")), turn).alias("turn"))
    # what is taken has lower places than what is kept
    grouped = taken.union(kept).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all trees of one task. The input is sorted by (ids, conv_id)."""
    part = TaskContext.get().partitionId()
    out: list[dict] = []

    def conversations() -> Iterator[tuple[bytes, int, list[int]]]:
        for batch in batches:
            for ids, conv_id, words in zip(batch.column(0), batch.column(1), batch.column(2)):
                yield b"".join(ids.as_py()), conv_id.as_py(), words.as_py()

    def rows() -> Iterator[dict]:
        first = last = None
        numbered = enumerate(conversations())
        for block, some in groupby(numbered, lambda x: x[0] // BLOCK):
            tree, borders = RadixTree(), []
            for key, same in groupby((row for _, row in some), lambda row: row[0]):
                held = [(conv_id, words) for _, conv_id, words in same]
                entry = (key, Held([conv_id for conv_id, _ in held], held[0][1]))
                tree.insert(*entry)
                borders[1:] = [entry] if borders else []
                borders = borders or [entry]
            if last is not None:
                yield from corrections(last[0], borders[0][0], borders[0][1].weights)
            first, last = first or borders[0], borders[-1]
            shared = {path_id(key) for key, _ in borders}
            for p in prefixes(tree, WIDTH):
                listed = ",".join(map(str, p.ends))
                split = p.ends and p.node in shared
                yield {"kind": _NODE, "node": p.node, "parent": p.parent, "depth": p.depth, "conv_id": p.first, "n_convs": p.members,
                       "n_children": p.children, "n_leaves": p.leaves, "weighed": p.weighed, "weight": p.weight,
                       "ends": hashlib.sha256(listed.encode()).hexdigest() if p.ends and not split else None}
                if split:
                    yield {"kind": _ENDS, "node": p.node, "part": part, "block": block, "ends": listed}
        if last is not None:
            yield {"kind": _BORDER, "part": part, "first": first[0], "words": first[1].weights, "last": last[0]}

    for row in rows():
        out.append(row)
        if len(out) == BATCH:
            yield pa.RecordBatch.from_pylist(out, _ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def path_id(key: bytes) -> bytes:
    """The node of a whole key."""
    node = ROOT
    for at in range(0, len(key), WIDTH):
        node = unit_id(node, key[at : at + WIDTH])
    return node


def corrections(last: bytes, first: bytes, words: list[int]) -> Iterator[dict]:
    """What two trees counted twice: ``last`` is the last key of one, ``first`` the first of the next."""
    least = min(len(last), len(first)) // WIDTH
    same = next((d for d in range(least) if last[d * WIDTH : (d + 1) * WIDTH] != first[d * WIDTH : (d + 1) * WIDTH]), least)
    no_leaf = same * WIDTH == len(last)  # it goes on in the next tree, or is counted there
    node, weight = ROOT, sum(words[:same])
    for depth in range(same + 1):
        if depth:
            node = unit_id(node, first[(depth - 1) * WIDTH : depth * WIDTH])
        yield {"kind": _NODE, "node": node, "depth": depth, "n_convs": 0, "n_children": -1 if depth < same else 0,
               "n_leaves": -1 if no_leaf else 0, "weighed": 0, "weight": -weight}
        weight -= words[depth - 1] if depth else 0


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist(list(corrections(row["last"], row["first"], row["words"])), _ARROW)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node over its texts, which come in order; only the state of one chain is held."""
    node, chain = None, None

    def done() -> pa.RecordBatch:
        row = {"kind": _NODE, "node": node, "n_convs": 0, "n_children": 0, "n_leaves": 0, "weighed": 0, "weight": 0, "ends": chain.hexdigest()}
        return pa.RecordBatch.from_pylist([row], _ARROW)

    for batch in batches:
        for of, ends in zip(batch.column(0), batch.column(1)):
            if of.as_py() != node:
                if chain is not None:
                    yield done()
                node, chain = of.as_py(), hashlib.sha256(ends.as_py().encode())
            else:
                chain.update(b"," + ends.as_py().encode())
    if chain is not None:
        yield done()


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id are left out; a null turn comes first, a null role or text is empty, turns of one number
    are ordered by the digest of role and text, so repeated rows are repeated turns. A conversation without turns
    after rebuilding is a member of the root alone. Texts of any length are digested in the scan. An empty table
    gives an empty result; other columns are left out.
    """
    spark = conversations.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rebuilt(conversations).repartitionByRange(tasks, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    parts = materialize(dealt.select("ids", "conv_id", "words").mapInArrow(_trees, _SCHEMA), "trie-parts")

    # one row a task: the last key of the task before
    before = Window.orderBy("part")
    borders = parts.where(F.col("kind") == _BORDER).select("part", "first", "words", "last")
    pairs = borders.withColumn("last", F.lag("last").over(before)).where(F.col("last").isNotNull())
    twice = pairs.mapInArrow(_between, _SCHEMA)
    split = parts.where(F.col("kind") == _ENDS).select("node", "ends", "part", "block")
    digests = split.repartition("node").sortWithinPartitions("node", "part", "block").select("node", "ends").mapInArrow(_digests, _SCHEMA)

    rows = parts.where(F.col("kind") == _NODE).union(twice).union(digests)
    sums = ["n_convs", "n_children", "n_leaves", "weighed", "weight"]
    nodes = materialize(
        rows.groupBy("node").agg(*[F.max(c).alias(c) for c in ("parent", "depth", "ends")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums]),
        "trie-nodes")
    above = nodes.where(F.col("n_children") > 0).select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("weighed") - F.col("weight")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: Steps of the checksum: a byte is mixed in, or one bit is shifted out (-1).
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda x: list_concat([ord(x)::BIGINT], list_value(-1, -1, -1, -1, -1, -1, -1, -1)::BIGINT[])))),
    lambda c, o: CASE WHEN o < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, o) END), 4294967295)"""

SQL = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS place, id, words
  FROM (SELECT conv_id, turn, left(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
  SELECT c.conv_id, t.place, t.id, t.words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.h
  UNION ALL
  SELECT c.conv_id, t.place, t.id, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h),
keys AS (
  SELECT c.conv_id, coalesce(list(b.id ORDER BY b.place) FILTER (b.id IS NOT NULL), []) AS ids,
         coalesce(list(b.words ORDER BY b.place) FILTER (b.id IS NOT NULL), []) AS words
  FROM convs c LEFT JOIN built b USING (conv_id) GROUP BY c.conv_id),
members AS (SELECT conv_id, ids, words, unnest(range(0, len(ids) + 1)) AS depth FROM keys),
nodes AS (
  SELECT array_to_string(ids[1:depth], '') AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         max(CASE WHEN depth > 0 THEN array_to_string(ids[1:depth - 1], '') END) AS parent,
         any_value(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(ids)), '')) AS ends_sha256
  FROM members GROUP BY ALL),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)),
below AS (
  SELECT left(node, 32 * d) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""
