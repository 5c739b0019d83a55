"""Tables that take each key once: repeated, overlapping and empty batches, and what a batch reads."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from flowtide.sources import keyed
from flowtide.sources.knowledge import add_knowledge, knowledge_size, load_knowledge


def _batch(spark, first, last):
    return spark.range(first, last).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.concat(F.lit("v"), "id").alias("v"))


def _add(batch, path):
    keyed.append_keyed(keyed.unstored(batch, path, "k"), path, "k")


def test_each_key_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for first, last, total in ((0, 0, 0), (0, 500, 500), (0, 500, 500), (300, 800, 800), (0, 800, 800)):
        _add(_batch(spark, first, last), path)
        assert spark.read.parquet(path).count() == total
    _add(_batch(spark, 790, 810).unionByName(_batch(spark, 790, 810)), path)
    _add(spark.createDataFrame([(None, "x")], "k string, v string"), path)
    rows = spark.read.parquet(path)
    assert sorted(r["v"] for r in rows.collect()) == sorted(f"v{i}" for i in range(810))
    assert rows.where(F.col("key_part") != keyed.part_of(F.col("k"))).count() == 0
    keyed.create_keyed(spark, path, rows.schema)
    assert spark.read.parquet(path).count() == 0


def test_a_batch_opens_its_own_folders_only(spark, tmp_path):
    path = str(tmp_path / "t")
    _add(_batch(spark, 0, 3000), path)
    one = _batch(spark, 5, 6)
    out = io.StringIO()
    with redirect_stdout(out):
        keyed.unstored(one, path, "k").explain("formatted")
    text = out.getvalue()
    assert re.search(r"PartitionFilters: \[.*key_part", text) and "ReadSchema: struct<k:string>" in text
    files = keyed.stored_keys(one, path, "k").select(F.input_file_name().alias("file")).distinct()
    assert files.count() == 1 < len(spark.read.parquet(path).inputFiles())


def test_knowledge_is_added_once(spark, tmp_path):
    path = str(tmp_path / "kb")
    rows = [(1, "alpha beta " * 100), (2, "gamma"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        add_knowledge(docs, "text", "doc_id", path)
        assert knowledge_size(spark, path) == 4
    before = {r["chunk_id"] for r in load_knowledge(spark, path).collect()}
    add_knowledge(spark.createDataFrame([(2, "delta"), (1, "alpha beta " * 100)], docs.schema), "text", "doc_id", path)
    after = load_knowledge(spark, path).collect()
    assert len(after) == 5 and [r["chunk"] for r in after if r["chunk_id"] not in before] == ["delta"]


def test_only_new_chunks_are_embedded(spark, tmp_path):
    path, seen = str(tmp_path / "kb"), []

    def embed(chunks):
        seen.append(chunks.count())
        return chunks.withColumn("embedding", F.array(F.lit(3.0), F.lit(4.0)))

    for last in (3, 3, 5):
        add_knowledge(spark.range(last).select("id", F.concat(F.lit("text "), "id").alias("text")), "text", "id", path, embed)
    assert seen == [3, 0, 2]
    assert {tuple(round(x, 6) for x in r["embedding"]) for r in load_knowledge(spark, path).collect()} == {(0.6, 0.8)}


def test_a_batch_of_a_stream_leaves_one_file_a_folder(spark, tmp_path):
    """Adaptive execution is off in the batches of a stream."""
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    _batch(spark, 0, 4000).write.parquet(source)
    stream = spark.readStream.schema("k string, v string").parquet(source).dropDuplicates(["k"])
    run = stream.writeStream.foreachBatch(lambda rows, _: _add(rows, path)).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(path).count() == 4000
    assert len(list((tmp_path / "t").glob("*/*.parquet"))) <= 256 + 1
