"""Near-duplicate groups: one-permutation hashing with optimal densification, banded buckets, star edges.

One pass over the texts writes a row of band keys and a 128-bit fingerprint of each whole shingle set.
Equal sets form a class with one representative, so copies never meet in a bucket. In two rounds the members
of a bucket are tied to one centre, the second time to one out of a smallest component, and tied pairs are
confirmed on whole sets. That finds the groups; what is left are buckets whose members still belong to several
components, and stars cannot rule out that two members other than the centre join them.

These buckets are closed exactly by a prefix filter. The shingles of their members are ordered by how many
members have them, the rarest first. Two sets at the similarity share one of the first fifth of either, and
the first one they share stands so early in both that enough shingles follow. Near copies that are no near
duplicates differ by rare shingles, so these take up their prefixes and hardly a pair is left. Only members
of different components meet, and of a shingle's members those outside its largest component with the others.

With 64 bands of 8 rows a pair at a similarity of 0.8 shares no band with a probability of 8e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.components import components
from flowtide.llm.sketches import band_keys, fingerprint, one_permutation, shingle_set
from flowtide.session import discard, materialize

BANDS, ROWS = 64, 8
#: Rounds of star edges.
ROUNDS = 2
#: Texts that are held as sketches at a time.
BLOCK = 256


def sketched(docs: DataFrame, words: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, fingerprint and band keys of each text; without words the last two are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                sets = [shingle_set(t.as_py(), words) for t in part.column(1)]
                full = [s for s in sets if len(s)]
                keys = iter(())
                if full:
                    sketches = np.stack([one_permutation(s, bands * rows) for s in full])
                    keys = iter(band_keys(sketches, bands, rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "fingerprint", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, fingerprint binary, bands array<long>")


def _whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The sets of the representatives ``wanted`` (rep, fingerprint), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                sets = [shingle_set(t.as_py(), words) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["rep", "found", "shingles"],
                )

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted.select("rep"), "rep", "left_semi")
    sets = texts.mapInArrow(run, "rep long, found binary, shingles binary")
    same = sets.join(wanted, "rep").where(F.col("found") == F.col("fingerprint"))
    return same.groupBy("rep").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _parted(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """bucket, rep, size and ``part``, the component so far, of the buckets with several parts; ``centre`` marks
    one member of a smallest part."""
    if labels is None:
        rows = live.withColumn("part", F.col("rep"))
    else:
        roots = labels.select(F.col("u").alias("rep"), F.col("v").alias("root"))
        rows = live.join(roots, "rep", "left").select("bucket", "rep", "size", F.coalesce("root", "rep").alias("part"))
    rows = rows.withColumn("h", F.xxhash64("rep"))
    parts = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "rep")).alias("first"))
    several = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.min(F.struct("n", F.col("first.h").alias("h"), F.col("first.rep").alias("rep"))).alias("c"),
    ).where(F.col("parts") > 1).drop("parts")
    return rows.join(several, "bucket").select("bucket", "rep", "size", "part", (F.col("rep") == F.col("c.rep")).alias("centre"))


def _star(parted: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of one round: in each bucket the centre and the members of other components, as far as
    their sizes admit the similarity."""
    centres = parted.where("centre").select("bucket", F.col("rep").alias("c"), F.col("size").alias("c_size"), F.col("part").alias("c_part"))
    tied = parted.join(centres, "bucket").where(
        (F.col("part") != F.col("c_part")) & (100 * F.least("size", "c_size") >= percent * F.greatest("size", "c_size")))
    return tied.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()


def _prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rep, part, size, shingle and its place (from 1) among the shingles of the set in order of rarity, for those
    in the prefix that members of several parts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lists = [np.frombuffer(s.as_buffer(), np.int64) for s in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int64()))], ["rep", "shingles"])

    listed = sets.join(members.select("rep"), "rep", "left_semi").select("rep", "shingles").mapInArrow(run, "rep long, shingles array<long>")
    shingles = materialize(members.join(listed, "rep").select("rep", "part", "size", F.explode("shingles").alias("shingle")), "shingles")
    # a shingle of one member alone is in no pair, but takes a place
    common = shingles.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where(F.col("n") > 1)
    own = Window.partitionBy("rep")
    ranked = shingles.join(common, "shingle").withColumns({
        "alone": F.col("size") - F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("n", "shingle"))})
    place = F.col("alone") + F.col("rank")
    out = materialize(
        ranked.where((100 * (F.col("size") - place + 1) >= percent * F.col("size")) & (F.col("low") < F.col("high")))
        .select("rep", "part", "size", "shingle", place.alias("place")), "prefixes")
    discard(shingles)
    return out


def _filtered(prefixes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different parts: all that can reach the similarity are among them."""
    by_part = prefixes.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = by_part.groupBy("shingle").agg(F.max(F.struct("n", "part")).alias("most")).select("shingle", F.col("most.part").alias("most"))
    others = prefixes.join(largest, "shingle").where(F.col("part") != F.col("most")).select(
        "shingle", F.col("rep").alias("o"), F.col("part").alias("o_part"), F.col("size").alias("o_size"), F.col("place").alias("o_place"))
    after = F.least(F.col("size") - F.col("place"), F.col("o_size") - F.col("o_place")) + 1
    met = prefixes.withColumnRenamed("shingle", "s").join(
        others, (F.col("s") == F.col("shingle")) & (F.col("part") != F.col("o_part"))
        & (100 * F.least("size", "o_size") >= percent * F.greatest("size", "o_size"))
        & ((100 + percent) * after >= percent * (F.col("size") + F.col("o_size"))))
    return met.select(F.least("rep", "o").alias("a"), F.greatest("rep", "o").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that links reach; ``kept`` is true for that document. A null,
    empty or blank text has no shingles and is its own component. Rows of one doc_id and text are copies of
    each other. A row without doc_id can't be named: its component is that of its copies, else null, and
    then it is kept. An empty table gives an empty result; columns other than doc_id and text are left out.
    """
    sketch = materialize(sketched(docs, words, bands, rows), "sketches")
    named = sketch.where(F.col("fingerprint").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(
        named.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.first("n_shingles").alias("size")), "classes")
    buckets = classes.select("rep", "size", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("bucket")
    live = materialize(buckets.join(shared, "bucket"), "buckets")
    wanted = materialize(classes.select("rep", "fingerprint").join(live.select("rep").distinct(), "rep", "left_semi"), "wanted")
    sets = materialize(_whole_sets(docs, wanted, words), "sets")
    discard(wanted)

    def linked(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        new = materialize(confirmed(pairs, sets, percent), "confirmed")
        found = components(new if labels is None else labels.select(F.col("u").alias("a"), F.col("v").alias("b")).union(new))
        discard(pairs, new, *([] if labels is None else [labels]))
        return found

    labels = None
    for _ in range(ROUNDS):
        parted = materialize(_parted(live, labels), "parted")
        discard(live)
        labels, live = linked(_star(parted, percent), labels), parted.select("bucket", "rep", "size")
        live._written_to = parted._written_to
    members = materialize(_parted(live, labels).select("rep", "part", "size").distinct(), "members")
    prefixes = _prefixes(members, sets, percent)
    labels = linked(_filtered(prefixes, percent), labels)
    discard(live, members, prefixes, sets)

    roots = labels.select(F.col("u").alias("rep"), F.col("v").alias("root"))
    of_class = classes.select("fingerprint", "rep").join(roots, "rep", "left").select(
        "fingerprint", F.coalesce("root", "rep").alias("root"))
    joined = sketch.select("doc_id", "n_shingles", "fingerprint").join(of_class, "fingerprint", "left")
    component = F.coalesce("root", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with one document of each group, all columns. Rows without doc_id stay."""
    found = materialize(near_duplicates(docs, **how), "groups").where(F.col("doc_id").isNotNull())
    by_id = materialize(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "verdicts")
    dropped = materialize(by_id.where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")), "dropped")
    left = docs.join(dropped, F.col("doc_id") == F.col("__dropped"), "left_anti")
    if by_id.where(F.col("kept") & (F.col("rows") > 1)).isEmpty():
        return left
    return left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(left.where(F.col("doc_id").isNull()))
