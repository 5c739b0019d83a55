"""Toxicity of texts, learned from labels: the recurrent network of ``attention_gru`` over all overlapping windows.

The fit takes a bounded sample on the driver: ``PER_LABEL`` labelled texts of at most ``MAX_CHARS`` characters
for each label, weighed as the labels of all rows to learn from are. Scoring takes every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.attention_gru import Network, train
from flowtide.session import materialize

#: Bounds of the sample the network is trained on.
PER_LABEL, MAX_CHARS = 1500, 8_000
#: A text of this score or more is called toxic.
THRESHOLD = 0.7
#: Characters of text that are scored at a time, about.
BLOCK_CHARS = 2_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> list:
    """text, mark and weight of the rows to learn from, at most ``per_label`` of each mark, by the hash of doc_id."""
    known = materialize(
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("mark")).withColumn("h", F.xxhash64("doc_id")), "labels")
    counts = {r["mark"]: r["n"] for r in known.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    # about twice as many as wanted by the hash, then exactly as many by rank
    near = known.where(F.coalesce(*[
        F.when(F.col("mark") == mark, F.pmod("h", F.lit(1 << 40)) * n < F.lit(2 * per_label) * (1 << 40)) for mark, n in counts.items()], F.lit(False)))
    place = F.row_number().over(Window.partitionBy("mark").orderBy("h", "doc_id"))
    chosen = near.withColumn("place", place).where(F.col("place") <= per_label).drop("place")
    # at most twice per_label rows, so the texts stay where they are
    found = docs.where(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id", "mark", "h").agg(F.min("text").alias("text")).orderBy("h", "doc_id").collect()
    drawn = {mark: sum(r["mark"] == mark for r in rows) for mark in counts}
    total = sum(counts.values())
    return [(r["text"], r["mark"], counts[r["mark"]] / drawn[r["mark"]] * len(rows) / total) for r in rows]


def scored(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id and the score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Network | None = shared.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0
                while at + len(texts) < batch.num_rows and chars < BLOCK_CHARS:
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                scores = [0.0] * len(texts) if found is None else found.scores(texts).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(scores, pa.float64())], ["doc_id", "score"])
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score is that of the highest window, from 0 to 1. A null or empty text and one without a word have one
    window without words. Without a label to learn from all scores are 0. Labels other than 0 and 1 and rows
    without doc_id teach nothing; of several labels of one doc_id the larger counts, of several texts the smaller.
    Every row is scored, repeated rows alike, texts of any length whole; an empty table gives an empty result; other
    columns are left out.
    """
    rows = sample(docs, labels, label)
    network = train(*map(list, zip(*rows))) if rows else None
    return scored(docs, network).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
