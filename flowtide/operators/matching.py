"""Search-result parsing and product-to-title matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.functions.text import default_search_url, strip
from flowtide.session import materialize

# A word must be longer than this to match a title, and rows kept per query.
SHORT_WORD = 3
PER_QUERY = 5


def union_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Result batches one after the other, numbered by batch."""
    out = None
    for i, part in enumerate(parts):
        numbered = part.withColumn("batch", F.lit(i))
        out = numbered if out is None else out.unionByName(numbered)
    return out


def parse_blocks(df: DataFrame, block: str, order: Sequence[str]) -> DataFrame:
    """One row per result in the text: lower-case title, url, and its place in the input."""
    results = df.select(*order, F.posexplode_outer(F.split(F.col(block), "\n\n")).alias("__pos", "__result"))
    lines = F.split(strip(F.col("__result")), "\n")

    def last_value(prefix: str) -> Column:
        found = F.filter(lines, lambda line: F.startswith(line, F.lit(prefix)))
        return strip(F.replace(F.try_element_at(found, F.lit(-1)), F.lit(prefix), F.lit("")))

    parsed = results.select(
        F.struct(*order, F.col("__pos")).alias("place"), last_value("Title: ").alias("title"), last_value("URL: ").alias("url")
    )
    return parsed.where((F.col("title") != "") & (F.col("url") != "")).withColumn("title", F.lower("title"))


def title_map(parsed: DataFrame) -> DataFrame:
    """One row per title: the last url written for it and the place it was first seen."""
    return parsed.groupBy("title").agg(F.max_by("url", "place").alias("url"), F.min("place").alias("first_seen"))


def _in_order(titles: DataFrame) -> DataFrame:
    """Titles with a number that grows with the place first seen, written once: the numbers
    come from a range partitioning and must not change between uses."""
    placed = titles.repartitionByRange("first_seen").sortWithinPartitions("first_seen")
    return materialize(placed.select("title", "url", F.monotonically_increasing_id().alias("ord")), "titles")


def _pieces(text: Column, lengths: Sequence[int]) -> Column:
    """All substrings of the given lengths."""
    none = F.slice(F.array(F.lit("")), 1, 0)

    def cut(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
        return F.coalesce(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))), none)

    return F.flatten(F.array(*[cut(n) for n in lengths])) if lengths else none


def match_urls(names: DataFrame, titles: DataFrame) -> DataFrame:
    """(name, url): the title equal to the name; else the first title that holds one of its
    longer words, or the whole name with blanks removed on both sides; else a search address.

    A word lies inside one word of a title, so title words are first reduced to distinct ones
    with their earliest title; likewise titles without blanks. Those are cut into substrings
    of just the lengths looked for, again reduced to the earliest title each, so matching is an
    equi-join with one partner per needle however many titles hold it.
    """
    ordered = _in_order(titles)
    wanted = names.select("name").where(F.col("name").isNotNull()).distinct().withColumn("__low", F.lower("name"))
    exact = wanted.join(ordered.select(F.col("title").alias("__low"), F.col("url").alias("__exact")), "__low", "left")

    words = F.transform(
        F.filter(F.split("__low", r"\s+"), lambda w: F.length(w) > SHORT_WORD),
        lambda w: F.struct(F.lit(0).alias("kind"), w.alias("needle")),
    )
    joined = F.struct(F.lit(1).alias("kind"), F.replace("__low", F.lit(" "), F.lit("")).alias("needle"))
    needles = wanted.select("name", F.inline_outer(F.array_append(words, joined))).where(F.col("needle") != "").distinct()
    # One number per distinct needle length: as many as the longest name is long.
    found_lengths = needles.select("kind", F.length("needle").alias("n")).distinct().collect()
    lengths = {kind: sorted(r["n"] for r in found_lengths if r["kind"] == kind) for kind in (0, 1)}

    texts = {0: F.explode_outer(F.split("title", r"\s+")), 1: F.replace("title", F.lit(" "), F.lit(""))}
    cut = None
    for kind, text in texts.items():
        distinct = ordered.select("ord", text.alias("__text")).groupBy("__text").agg(F.min("ord").alias("ord"))
        pieces = distinct.select("ord", F.lit(kind).alias("kind"), F.explode_outer(_pieces(F.col("__text"), lengths[kind])).alias("needle"))
        cut = pieces if cut is None else cut.unionByName(pieces)
    earliest = cut.groupBy("kind", "needle").agg(F.min("ord").alias("ord"))
    partial = (
        needles.join(earliest, ["kind", "needle"])
        .groupBy("name")
        .agg(F.min("ord").alias("ord"))
        .join(ordered.select("ord", F.col("url").alias("__partial")), "ord")
        .drop("ord")
    )
    return exact.join(partial, "name", "left").select(
        "name", F.coalesce("__exact", "__partial", default_search_url(F.col("name"))).alias("url")
    )


def first_per_query(df: DataFrame, query: str, order: Sequence[Column], n: int = PER_QUERY) -> DataFrame:
    """The first ``n`` rows of each query; Spark trims each group before the shuffle."""
    ranking = Window.partitionBy(query).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranking)).where(F.col("__rank") <= n).drop("__rank")
