"""The knowledge table: text chunks with normalised vectors, appended and searched."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.functions.text import chunk_text
from flowtide.functions.vectors import l2_normalize
from flowtide.operators.neighbors import nearest
from flowtide.operators.retrieval import hashed_terms
from flowtide.sources.keyed import append_keyed, unstored

# Chunk size and overlap, and the places a chunk prefers to break at.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
SEPARATORS = ["\n\n", "\n", " "]


def _pieces(text: str, size: int, separators: Sequence[str]) -> Iterator[str]:
    """Parts of at most ``size`` characters, each keeping the separator in front of it."""
    if len(text) <= size:
        yield text
        return
    for depth, separator in enumerate(separators):
        if separator in text:
            first, *rest = text.split(separator)
            for part in [first, *[separator + r for r in rest]]:
                if part:
                    yield from _pieces(part, size, separators[depth + 1 :]) if len(part) > size else [part]
            return
    for start in range(0, len(text), size):
        yield text[start : start + size]


def _packed(text: str, size: int, overlap: int) -> list[str]:
    """Greedy chunks of the parts; each new chunk repeats up to ``overlap`` trailing characters."""
    chunks, held, used = [], [], 0
    for piece in _pieces(text, size, SEPARATORS):
        if held and used + len(piece) > size:
            chunks.append("".join(held).strip())
            while held and (used > overlap or used + len(piece) > size):
                used -= len(held.pop(0))
        held.append(piece)
        used += len(piece)
    if held:
        chunks.append("".join(held).strip())
    return [c for c in chunks if c]


def chunk_at_separators(
    df: DataFrame, text: str, keep: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Chunks broken at paragraphs, then lines, then words; inside a word only when it alone
    is too long."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _packed(t, size, overlap), na_action="ignore")

    return df.where(F.col(text).isNotNull()).select(*keep, F.posexplode_outer(cut(F.col(text))).alias("chunk_no", "chunk")).where(
        F.col("chunk").isNotNull()
    )


def add_knowledge(
    df: DataFrame,
    text: str,
    doc_id: str,
    path: str,
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Chunk, embed, normalise and append. ``embed`` adds ``embedding`` to rows with ``chunk``;
    the offline default hashes words. A chunk is named by its document, number and text: one that is stored
    is neither embedded nor added again, and a changed text adds its changed chunks."""
    facts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("chunk_no").cast("string"), F.col("chunk")]
    chunks = chunk_text(df, text, [doc_id]).withColumn("chunk_id", F.sha2(F.concat_ws(":", *facts), 256))
    fresh = unstored(chunks, path, "chunk_id")
    if embed:
        vectors = embed(fresh).withColumn("embedding", l2_normalize(F.col("embedding")))
    else:
        vectors = hashed_terms(fresh, "chunk")  # already at unit length
    append_keyed(vectors.select(doc_id, "chunk_id", "chunk", "embedding"), path, "chunk_id")


def load_knowledge(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def knowledge_size(spark: SparkSession, path: str) -> int:
    return load_knowledge(spark, path).count()


def retrieve(queries: DataFrame, knowledge: DataFrame, query_id: str, k: int = 5) -> DataFrame:
    """The ``k`` most similar chunks of each query row (``query_id``, ``embedding``)."""
    found = nearest(queries, knowledge, k, "cosine", query_id=query_id, reference_id="chunk_id")
    return found.join(knowledge.select("chunk_id", "chunk"), "chunk_id")
