"""K-d tree partitioning: split at distributed weighted medians until leaves reach the target bytes.

Every row becomes a point of small integers, one per metadata dimension. A level of the tree finds the
widest dimension of each node (its range against the range of the whole table) and cuts the node where
the bytes before the cut match the leaves that go left. A cut is found by descending the digits of one
63-bit order key, ``dimension | checksum of the text | hash of the row``: each round is one aggregate of
at most 256 sums a node, so no node is ever sorted or gathered, and a dimension value, a text or a
source that holds a third of all rows is cut through the middle like any other. Equal texts are
neighbours in every order and stay together unless a cut falls inside their group.

The driver holds the tree, one row a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import values
from flowtide.operators.segments import ranked
from flowtide.session import materialize

DIM_BITS, CRC_BITS, ROW_BITS, DIGIT = 16, 32, 15, 8
KEY_BITS = DIM_BITS + CRC_BITS + ROW_BITS
#: A cut is settled when the rows it could still move hold at most this share of the node's bytes.
TOLERANCE = 1 / 4096
#: Rows that are numbered in one task.
BLOCK_ROWS = 4096


@dataclass
class _Search:
    node: int
    dim: int
    target: float
    weight: float
    prefix: int = 0
    bits: int = 0
    cut: int | None = None


def document_size(text: Column) -> Column:
    """UTF-8 bytes of a text and one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def magnitude(size: Column) -> Column:
    """A size on a logarithmic scale, 1024 steps an octave."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1))) * 1024), F.lit((1 << DIM_BITS) - 1)).cast("long")


def category(value: Column) -> Column:
    """A place for a category; null has its own."""
    return F.pmod(F.xxhash64(value), F.lit(1 << DIM_BITS)).cast("long")


def prepare(
    df: DataFrame,
    keep: list[str] | None = None,
    text: str = "text",
    dims: dict[str, Column] | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """A ``row`` struct of the kept columns (all without a list) and a ``kd`` struct of size, checksum,
    order hash and dimensions, written once so that every level reads the same row hashes."""
    size = document_size(F.col(text))
    dims = dims or {"size": magnitude(size), "lang": category(F.col("lang")), "source": category(F.col("source"))}
    packed = df.select(F.struct(*(keep or ["*"])).alias("row"), F.struct(
        size.alias("size"),
        text_checksum(F.col(text)).alias("crc"),
        F.xxhash64(F.col(key), F.monotonically_increasing_id()).alias("hash"),
        F.array(*dims.values()).alias("dims"),
    ).alias("kd"))
    return materialize(packed, "kd-points")


def _order_key(dim: Column) -> Column:
    high = F.shiftleft(F.element_at("kd.dims", dim + 1), CRC_BITS + ROW_BITS)
    return high + F.shiftleft(F.col("kd.crc"), ROW_BITS) + F.shiftrightunsigned(F.col("kd.hash"), 64 - ROW_BITS)


def _at_node(rows: DataFrame, facts: list[tuple], schema: str) -> DataFrame:
    """Facts about nodes joined to their rows; of the root alone, as plain values."""
    if len(facts) == 1 and facts[0][0] == 1:
        names = [part.split() for part in schema.split(",")]
        return rows.withColumns({name: F.lit(value).cast(kind) for (name, kind), value in zip(names, facts[0])})
    table = values(rows.sparkSession, facts, schema)
    return rows.join(table, F.col("node") == F.col(schema.split()[0]), "left")


def assign(points: DataFrame, tree: list[list[tuple]]) -> DataFrame:
    """Add ``node``, the leaf of every row: 1 at the root, then twice the node, plus one at or after the cut."""
    out = points.withColumn("node", F.lit(1).cast("long"))
    for level in tree:
        joined = _at_node(out, level, "at_node long, at_dim int, at_cut long")
        right = F.when(_order_key(F.col("at_dim")) >= F.col("at_cut"), 1).otherwise(0)
        out = joined.withColumn(
            "node", F.when(F.col("at_node").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right)
        ).drop("at_node", "at_dim", "at_cut")
    return out


def _descend(points: DataFrame, tree: list[list[tuple]], open_: list[_Search]) -> None:
    """One digit for every open search: which cell holds the cut, and the bytes before it."""
    bits = open_[0].bits
    width = min(DIGIT, KEY_BITS - bits)
    shift = KEY_BITS - bits - width
    state = [(s.node, s.dim, s.prefix, float(s.target)) for s in open_]
    key = _order_key(F.col("at_dim"))
    cells = (
        _at_node(assign(points, tree), state, "at_node long, at_dim int, at_prefix long, at_target double")
        .where(F.shiftright(key, shift + width) == F.col("at_prefix"))
        .groupBy("node", "at_target", F.shiftright(key, shift).bitwiseAND((1 << width) - 1).alias("digit"))
        .agg(F.sum("kd.size").alias("bytes"))
    )
    before = Window.partitionBy("node").orderBy("digit")
    found = (
        cells.withColumn("upto", F.sum("bytes").over(before))
        .where(F.col("upto") >= F.col("at_target"))
        .groupBy("node").agg(F.min_by(F.struct("digit", "bytes", "upto"), "digit").alias("cell"))
    )
    cell_of = {r["node"]: r["cell"] for r in found.collect()}
    for s in open_:
        cell = cell_of[s.node]
        start = cell["upto"] - cell["bytes"]
        s.prefix, s.bits = (s.prefix << width) | cell["digit"], bits + width
        if cell["bytes"] <= s.weight * TOLERANCE or s.bits == KEY_BITS:
            after = cell["upto"] - s.target < s.target - start
            s.cut = min((s.prefix + (1 if after else 0)) << (KEY_BITS - s.bits), (1 << KEY_BITS) - 1)
        s.target -= start


def grow(points: DataFrame, leaves: int) -> tuple[list[list[tuple]], list[int]]:
    """The levels of the tree, each a list of (node, dimension, cut), and the leaves in order."""
    n_dims = points.select(F.max(F.size("kd.dims"))).first()[0]
    tree: list[list[tuple]] = []
    wanted = {1: leaves}
    ranges: list[float] | None = None
    while any(k > 1 for k in wanted.values()):
        spans = [f(F.element_at("kd.dims", i + 1)).alias(f"{n}{i}") for i in range(n_dims or 0) for n, f in (("lo", F.min), ("hi", F.max))]
        facts = {r["node"]: r for r in assign(points, tree).groupBy("node").agg(F.sum("kd.size").alias("bytes"), *spans).collect()}
        searches = []
        for node, k in wanted.items():
            if k == 1:
                continue
            if node not in facts:  # nothing to cut
                searches.append(_Search(node, 0, 0, 0, cut=0))
                continue
            row = facts[node]
            spread = [row[f"hi{i}"] - row[f"lo{i}"] for i in range(n_dims)]
            ranges = ranges or [max(1, x) for x in spread]
            widest = max(range(n_dims), key=lambda i: spread[i] / ranges[i])
            searches.append(_Search(node, widest, row["bytes"] * (k // 2) / k, row["bytes"]))
        while open_ := [s for s in searches if s.cut is None]:
            _descend(points, tree, open_)
        tree.append([(s.node, s.dim, s.cut) for s in searches])
        wanted = {
            child: share
            for node, k in wanted.items()
            for child, share in (((node, 1),) if k == 1 else ((2 * node, k // 2), (2 * node + 1, k - k // 2)))
        }
    depth = len(tree)
    order = sorted(wanted, key=lambda node: node << (depth - node.bit_length() + 1))
    return tree, order


def shard(points: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Add ``shard``, 0 to the number of leaves less one. Give the leaves, or the bytes a leaf should reach."""
    if leaves is None:
        total = points.select(F.sum("kd.size")).first()[0] or 0
        leaves = max(1, -(-total // target_bytes))
    tree, order = grow(points, leaves)
    names = [(node, i) for i, node in enumerate(order)]
    return _at_node(assign(points, tree), names, "leaf long, shard int").drop("node", "leaf")


def slots(sharded: DataFrame) -> DataFrame:
    """Add ``slot``, gapless from 0 in every shard, numbered block by block."""
    rows = sharded.select(F.count(F.lit(1))).first()[0]
    blocks = max(1, rows // (8 * BLOCK_ROWS))
    part = F.floor((F.col("kd.hash").cast("double") / 2.0**64 + 0.5) * blocks)
    numbered = ranked(sharded, ["shard"], part, [F.col("kd.hash"), F.col("kd.crc")], "slot")
    return numbered.withColumn("slot", (F.col("slot") - 1).cast("long"))


def shard_documents(docs: DataFrame, leaves: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, dims.

    The law is ``bytes``: leaves of near equal size. A null text has no bytes and checksum 0; a null
    language, source or id is a value of its own; repeated rows are separate rows, so a cut may pass
    between them; an empty table gives an empty result; other columns are left out.
    """
    placed = slots(shard(prepare(docs, ["doc_id"]), leaves))
    return placed.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("kd.size").alias("size"),
        F.col("kd.crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
