"""Temperature mixing: source shares raised to an exponent that meets a target, realised as block permutations.

The exponent of the token shares is bisected until the weights reach a target entropy, or until the
most repeated source meets a repetition limit. Each source then gets a token budget. It is used in whole
epochs, and for the rest in a permutation of blocks: blocks are taken in order of a hash of seed, source,
epoch and block while the budget lasts, and the one that crosses it is taken document by document. What is
taken is described by one row a source, the last block and the last document hash, so the documents
themselves are never shuffled, ranked or gathered, however many a source has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import TOKEN
from flowtide.operators.segments import running_sums
from flowtide.session import materialize

#: Tokens in a block, about; halvings of the exponent in one job, and jobs.
BLOCK_TOKENS = 1_000_000
HALVINGS, JOBS = 4, 8


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))).cast("long")


def prepare(docs: DataFrame, keep: list[str] | None = None, tokens: Column | None = None, key: str = "doc_id") -> DataFrame:
    """A ``row`` struct of the kept columns (all without a list) and a ``mix`` struct of source, tokens and
    hash, written once so that every step reads the same hashes. A null source is a source of its own."""
    tokens = word_count(F.col("text")) if tokens is None else tokens
    packed = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.struct(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source"),
        tokens.alias("tokens"), F.xxhash64(key, F.monotonically_increasing_id()).alias("hash")).alias("mix"))
    return materialize(packed, "mix-rows")


def _bisect(evaluate: Callable[[list[float]], list[bool]]) -> float:
    """The smallest exponent from 0 to 1 from which on ``evaluate`` is true, or 1. Four halvings are
    evaluated in one job."""
    low, high, parts = 0.0, 1.0, 1 << HALVINGS
    if evaluate([0.0])[0]:
        return 0.0
    for _ in range(JOBS):
        inner = [low + (high - low) * i / parts for i in range(1, parts)]
        first = next((i for i, met in enumerate(evaluate(inner)) if met), len(inner))
        low, high = ([low, *inner])[first], ([*inner, high])[first]
    return round(high, 9)


def exponent(totals: DataFrame, entropy_share: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent for a table of ``source``, ``tokens``.

    With ``entropy_share``, the largest whose weights have that share of the entropy of equal weights; with
    ``max_repeats``, the smallest that uses no source more often than that against the largest source.
    """
    known = totals.where(F.col("tokens") > 0)
    facts = known.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least"),
                      F.count(F.lit(1)).alias("n")).first()
    if not facts["n"] or facts["n"] == 1:
        return 1.0
    share = F.col("tokens") / facts["all"]
    if max_repeats is not None:
        def within(exponents: list[float]) -> list[bool]:
            row = known.agg(*[F.max(F.pow(F.col("tokens") / facts["most"], F.lit(a - 1))) for a in exponents]).first()
            return [r <= max_repeats for r in row]

        return _bisect(within)

    def flat_enough(exponents: list[float]) -> list[bool]:
        sums = [x for a in exponents for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]
        row = known.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).selectExpr(
            *[f"ln(s{2 * i}) - {a!r} * s{2 * i + 1} / s{2 * i} AS h{i}" for i, a in enumerate(exponents)],
        ).first()
        # entropy falls as the exponent grows: past the target is past the answer
        bound = entropy_share * F.log(F.lit(float(facts["n"])))
        target = totals.sparkSession.range(1).select(bound).first()[0]
        return [h < target for h in row]

    return _bisect(flat_enough)


def budgets(totals: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """source, tokens, blocks, weight, epochs, rest: whole epochs of each source and the tokens of the next
    one. Without a budget the mixture is as large as the largest source, used once, allows."""
    known = totals.where(F.col("tokens") > 0)
    facts = known.agg(F.sum(F.pow("tokens", F.lit(alpha))).alias("z"), F.max("tokens").alias("most")).first()
    z, most = facts["z"] or 1.0, facts["most"] or 1
    total = budget if budget is not None else most * z / most**alpha
    weight = F.pow("tokens", F.lit(alpha)) / z
    uses = weight * total / F.col("tokens")
    epochs = F.floor(uses + 1e-9).cast("long")
    return known.select(
        "source", "tokens", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("long").alias("blocks"), weight.alias("weight"),
        epochs.alias("epochs"), F.greatest(F.lit(0), F.floor((uses - epochs) * F.col("tokens") + 1e-6)).cast("long").alias("rest"))


def _block(blocks: Column) -> Column:
    """The block of a row, even over its source."""
    return F.least(F.floor((F.shiftrightunsigned(F.col("mix.hash"), 11).cast("double") / 2.0**53) * blocks), blocks - 1)


def _turn(seed: int, source: Column, epoch: Column, block: Column) -> Column:
    """Where a block stands in the permutation of an epoch."""
    return F.xxhash64(F.lit(seed), source, epoch, block)


def plan(rows: DataFrame, seed: int = 0, entropy_share: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """One row a source: of_source, weight, blocks, epochs, last_turn and last_hash, where the partial epoch ends.
    Without a target, repeats are limited to 4."""
    if entropy_share is None and max_repeats is None:
        max_repeats = 4.0
    totals = materialize(rows.groupBy("mix.source").agg(F.sum("mix.tokens").alias("tokens")), "mix-totals")
    given = materialize(
        budgets(totals, exponent(totals, entropy_share, max_repeats), budget).withColumnRenamed("source", "of_source"), "mix-budgets")
    placed = rows.join(given, F.col("mix.source") == F.col("of_source")).where(F.col("rest") > 0).withColumn("block", _block(F.col("blocks")))
    turn = _turn(seed, F.col("of_source"), F.col("epochs"), F.col("block"))
    sizes = placed.groupBy("of_source", "epochs", "rest", "block").agg(F.sum("mix.tokens").alias("size")).withColumn("turn", turn)
    upto = running_sums(sizes, ["of_source"], F.shiftright("turn", 56), [F.col("turn")], {"upto": "size"})
    crossing = materialize(
        upto.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") <= F.col("rest")))
        .groupBy("of_source").agg(F.min_by(F.struct("turn", "block", (F.col("rest") - F.col("upto") + F.col("size")).alias("left")), "turn").alias("c")),
        "mix-crossing")
    ends = crossing.select(F.col("of_source").alias("s"), F.col("c.block").alias("b"), F.col("c.left").alias("left"))
    inside = placed.select("of_source", "block", "mix.hash", "mix.tokens").join(ends, (F.col("of_source") == F.col("s")) & (F.col("block") == F.col("b")))
    along = Window.partitionBy("of_source").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.sum("tokens").over(along)).where(F.col("upto") <= F.col("left")).groupBy("of_source").agg(F.max("hash").alias("last_hash"))
    cuts = crossing.select("of_source", F.col("c.turn").alias("last_turn")).join(last, "of_source", "left")
    return materialize(given.join(cuts, "of_source", "left"), "mix-plan")


def mixed(rows: DataFrame, how: DataFrame, seed: int = 0) -> DataFrame:
    """Every use of every row: row, mix, epoch, block, turn. Within a source, (epoch, turn, hash) is the order of
    use. A source without tokens is used once."""
    joined = rows.join(how, F.col("mix.source") == F.col("of_source"), "left").withColumn("block", _block(F.col("blocks")))
    turn = _turn(seed, F.col("of_source"), F.col("epochs"), F.col("block"))
    again = F.col("rest") > 0
    again &= F.col("last_turn").isNull() | (turn < F.col("last_turn")) | ((turn == F.col("last_turn")) & (F.col("mix.hash") <= F.col("last_hash")))
    uses = F.coalesce(F.col("epochs"), F.lit(1)) + F.coalesce(again.cast("int"), F.lit(0))
    used = joined.where(uses > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), uses - 1)))
    return used.select("row", "mix", "epoch", "block", _turn(seed, F.col("of_source"), F.col("epoch"), F.col("block")).alias("turn"))


def mixture(docs: DataFrame, seed: int = 0, **target) -> DataFrame:
    """One row for each use of a document: doc_id, source, tokens, epoch, block, turn.

    A null source is a source of its own; null and empty texts have no tokens and go with their source;
    repeated rows are used one by one; an empty table gives an empty result; columns other than doc_id,
    text and source are left out.
    """
    rows = prepare(docs, ["doc_id", "source"])
    return mixed(rows, plan(rows, seed, **target), seed).select("row.doc_id", "row.source", "mix.tokens", "epoch", "block", "turn")


def mixed_documents(docs: DataFrame, seed: int = 0, **target) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture uses it, all columns."""
    rows = prepare(docs)
    return mixed(rows, plan(rows, seed, **target), seed).select("row.*")
