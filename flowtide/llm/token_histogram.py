"""Exact length histogram: documents aggregated by encoded length, and suffix sums over the lengths.

Each text is encoded whole; only its length leaves the task, and lengths are counted before the shuffle,
so the histogram has one row for each length that occurs. Suffix sums then answer totals, quantiles and the
tokens that are left under any context limit without another look at the texts.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.operators.segments import running_sums
from flowtide.session import materialize

#: How the vocabulary's encoder cuts a text before merging; a fixed value that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths that are summed in one piece.
SEGMENT = 1024

_encoders: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoder(name: str, pattern: str, content: bytes) -> tiktoken.Encoding:
    """The encoder of a vocabulary file, made once in a process."""
    if (name, pattern) not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        _encoders[name, pattern] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name, pattern]


def token_counter(spark, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """A function of a text column: its encoded length; null counts as empty. The vocabulary, a file of the
    driver of some megabytes, is broadcast, so executors need no file."""
    with open(vocabulary, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        own = encoder(vocabulary, pattern, shared.value)
        return pa.array([len(own.encode_ordinary(t.as_py() or "")) for t in texts], pa.int64())

    return count


def histogram(docs: DataFrame, length: Column) -> DataFrame:
    """n_tokens, n_docs: how many documents have each length."""
    return docs.select(length.alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: n_tokens, n_docs, docs_below, docs_from,
    tokens_from, kept_tokens (all documents cut at the limit), lost_tokens, quantile (share of documents up
    to this length)."""
    known = materialize(counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    # from the longest down, so that running totals are suffix sums
    down = (F.lit(0) - F.floor(F.col("n_tokens") / SEGMENT)).cast("long")
    summed = running_sums(known, [], down, [F.col("n_tokens").desc()], {"docs_from": "n_docs", "tokens_from": "tokens"})
    totals = known.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens")).first()
    docs, tokens = F.lit(totals["all_docs"] or 0), F.lit(totals["all_tokens"] or 0)
    kept = tokens - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    return summed.select(
        "n_tokens", "n_docs", (docs - F.col("docs_from")).alias("docs_below"), "docs_from", "tokens_from",
        kept.alias("kept_tokens"), (tokens - kept).alias("lost_tokens"),
        ((docs - F.col("docs_from") + F.col("n_docs")) / docs).alias("quantile"))


def kept_under(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``, whether that length occurs or not."""
    row = sums.agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs"))).first()
    return row[0] or 0


def length_at(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents does not pass."""
    return sums.where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The suffix sums of all documents by encoded length.

    A null or empty text has length 0 and counts; repeated rows count each; an empty table gives an empty
    result; columns other than text are left out.
    """
    count = token_counter(docs.sparkSession, vocabulary, pattern)
    return suffix_sums(histogram(docs, count(F.col("text"))))
