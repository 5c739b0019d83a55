"""HTML extraction by consensus host paths.

A first pass parses every page, scores its containers by the article text they hold, and votes for the
generalised tag-class path of the best one. Votes are summed per host and path in Spark; the paths that at
least a twentieth of a host's pages vote for win. Blocks that a page has outside its best container are counted
per host, too.

A second pass extracts each page again. What stands in an article or main element is the article. On a page
without one the host's winning path says where the article is, and of the rest only those blocks go that repeat
on the host's pages, or stand where most of what its pages have repeats: a heading, a lead or a closing line
outside the path stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.llm.html_pages import Block, Page, is_link_list, parse
from flowtide.session import discard, materialize

#: For its vote a page goes into a container that holds this share of its parent's text.
HELD = 0.8
#: Share of a host's pages that makes a path win; so a host has at most 20.
WINS = 0.05
#: A block outside the paths repeats if so many of a host's different pages have it, and this share of them.
REPEATS, REPEATS_SHARE = 3, 0.1
#: A place outside the paths goes if this share of its blocks repeats.
MOSTLY = 0.8

def _good(page: Page) -> list[Block]:
    return [b for b in page.blocks if not b.skipped and not is_link_list(b)]


def _weights(page: Page) -> list[int]:
    """Characters of article text in every container."""
    weight = [0] * len(page.names)
    for block in _good(page):
        weight[block.holder] += len(block.text) - block.links
    for i in range(len(weight) - 1, 0, -1):
        weight[page.parents[i]] += weight[i]
    return weight


def best_container(page: Page, weight: list[int]) -> int:
    """From the whole page down, as long as one container holds most of the text."""
    children: dict[int, list[int]] = {}
    for i, parent in enumerate(page.parents):
        children.setdefault(parent, []).append(i)
    at = 0
    while True:
        inner = max(children.get(at, []), key=lambda i: weight[i], default=None)
        if inner is None or weight[inner] < HELD * weight[at] or not weight[inner]:
            return at
        at = inner


def _inside(page: Page, chosen: set[int]) -> list[bool]:
    """Of every container, whether it is one of the chosen or lies in one."""
    inside = [False] * len(page.names)
    for i, parent in enumerate(page.parents):
        inside[i] = i in chosen or (parent >= 0 and inside[parent])
    return inside


def _mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _places(page: Page) -> list[int]:
    """A mark of the generalised path of every container."""
    marks = [0] * len(page.names)
    for i in range(1, len(marks)):
        marks[i] = _mark(f"{marks[page.parents[i]]}>{page.names[i]}")
    return marks


def extract(html: str, paths: list[str], repeated: frozenset[int] = frozenset()) -> tuple[str, str]:
    """The main text of a page and the path of its container; ``paths`` are its host's, best first, and ``repeated``
    the marks of blocks and places that repeat on its host."""
    page = parse(html)
    weight = _weights(page)
    # outermost main elements, or else outermost articles, that hold text
    outermost: dict[str, set[int]] = {"main": set(), "article": set()}
    for kind, found in outermost.items():
        within = [False] * len(page.names)
        for i, name in enumerate(page.names):
            above = page.parents[i] >= 0 and within[page.parents[i]]
            own = name.split(".")[0] == kind
            within[i] = above or own
            if own and not above and weight[i]:
                found.add(i)
    own = outermost["main"] or outermost["article"]
    if own:
        inside = _inside(page, own)
        text = [b.text for b in _good(page) if inside[b.holder]]
        return "\n".join(text), page.path(best_container(page, weight))
    chosen = next((places for places in (set(page.places(p)) for p in paths) if any(weight[i] for i in places)), set())
    inside = _inside(page, chosen)
    gone = [mark in repeated for mark in _places(page)] if repeated else [False] * len(page.names)
    text = [
        b.text for b in page.blocks
        if not b.skipped and (inside[b.holder] or not (is_link_list(b) or gone[b.holder] or _mark(b.text) in repeated))]
    return "\n".join(text), page.path(min(chosen, default=best_container(page, weight)))


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def ballots(pages: DataFrame) -> DataFrame:
    """host, page (a mark of its source), path, score, and ``outside``, marks of the blocks and their places outside
    the container that the page votes for and outside articles."""
    kind = pa.list_(pa.struct([("block", pa.int64()), ("place", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, paths, scores, outside = [], [], [], []
            for html in batch.column(1):
                source = html.as_py()
                page = parse(source)
                weight = _weights(page)
                best = best_container(page, weight)
                inside = _inside(page, {best})
                marks.append(_mark(source))
                paths.append(page.path(best))
                scores.append(weight[best])
                places = _places(page)
                left = {(_mark(b.text), places[b.holder]) for b in _good(page) if not b.article and not inside[b.holder]}
                outside.append([{"block": block, "place": place} for block, place in sorted(left)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks, pa.int64()), pa.array(paths, pa.string()), pa.array(scores, pa.int64()), pa.array(outside, kind)],
                ["host", "page", "path", "score", "outside"])

    known = pages.select(host(F.col("url")).alias("host"), "html").where(F.col("host").isNotNull() & F.col("html").isNotNull())
    return known.mapInArrow(run, "host string, page long, path string, score long, outside array<struct<block:long,place:long>>").where(F.col("score") > 0)


def consensus(pages: DataFrame) -> DataFrame:
    """of_host, paths (best first) and repeated: what wins the vote of a host, and the blocks its pages repeat."""
    cast = materialize(ballots(pages), "ballots")
    counted = materialize(
        cast.where(F.col("path") != "").groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum("score").alias("score")), "path-votes")
    totals = counted.groupBy("host").agg(F.sum("pages").alias("all"))
    won = counted.join(totals, "host").where(F.col("pages") >= WINS * F.col("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("n"), (-F.col("score")).alias("s"), "path")))
    paths = won.groupBy(F.col("host").alias("of_host")).agg(ranked["path"].alias("paths"))

    # copies of a page count once
    different = cast.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    left = cast.select("host", "page", F.inline("outside")).distinct()
    blocks = left.select("host", "page", "block").distinct().groupBy("host", "block").agg(F.count(F.lit(1)).alias("pages"))
    often = materialize(
        blocks.where(F.col("pages") >= REPEATS).join(different, "host").where(F.col("pages") >= REPEATS_SHARE * F.col("all")).select("host", "block"), "repeated")
    known = often.select(F.col("host").alias("h"), F.col("block").alias("b"))
    places = left.join(known, (F.col("host") == F.col("h")) & (F.col("block") == F.col("b")), "left").groupBy("host", "place").agg(
        F.count(F.lit(1)).alias("all"), F.count("b").alias("known")).where(F.col("known") >= F.greatest(F.lit(REPEATS), MOSTLY * F.col("all")))
    marks = often.union(places.select("host", "place"))
    repeated = marks.groupBy(F.col("host").alias("of")).agg(F.collect_list("block").alias("repeated"))
    out = materialize(paths.join(repeated, F.col("of_host") == F.col("of"), "left").drop("of"), "host-paths")
    discard(cast, counted, often)
    return out


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("path", T.StringType()))
def _extracted(html: pa.Array, paths: pa.Array, repeated: pa.Array) -> pa.Array:
    found = [extract(h.as_py() or "", p.as_py() or [], frozenset(r.as_py() or ())) for h, p, r in zip(html, paths, repeated)]
    return pa.StructArray.from_arrays(
        [pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], ["text", "path"])


def extracted_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, path.

    A null or empty page, or one without article text, has the empty text. A page without a host in its url has no
    paths and nothing that repeats. Repeated rows are extracted one by one and vote one by one; a page of any length
    or depth is parsed whole, in time and memory that grow with its length; an empty table gives an empty result;
    columns other than page_id, url and html are left out.
    """
    known = consensus(pages)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    joined = rows.join(known, F.col("host") == F.col("of_host"), "left")
    found = joined.select("page_id", "url", _extracted("html", "paths", "repeated").alias("e"))
    return found.select(
        "page_id", "url", F.col("e.text").alias("text"), F.length("e.text").cast("long").alias("n_chars"), F.col("e.path").alias("path"))
