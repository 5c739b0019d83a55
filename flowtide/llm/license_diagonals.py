"""License scans by diagonal voting.

All rolling word k-grams of the texts, pairs for the phrases and triples for the notices, are hashed and joined in
Spark with the hashed k-grams of license templates. A match at word ``p`` of the text and word ``t`` of a template
votes for the diagonal ``p - t``, where the template would begin. Votes are aggregated to one row a diagonal and
stretch of the template, a bit for each place, before anything is shuffled; neighbouring diagonals, which an
inserted or missing word shifts apart, are merged; what is left is verified: a phrase needs every place on one
diagonal, a notice most of its places in a span about its own length, and half of the places that no template of
another label has, since notices of one family share most of their words.

The templates are a fixed table, so the joined side is small whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import WORD, lowered, values

#: Words in a k-gram of a phrase and of a notice.
PHRASE_K, NOTICE_K = 2, 3
#: Diagonals this near belong to one copy; share of its places a notice needs, and of the places only its label has;
#: longest span against its length.
NEAR, COVERED, OWN, STRETCH = 4, 0.6, 0.5, 1.5
#: Template places in one row of votes.
BITS = 62


@dataclass(frozen=True)
class Template:
    """A text of any length. A phrase counts in the base digest, a notice adds a label."""

    label: str
    text: str
    phrase: bool = False

    @property
    def grams(self) -> list[tuple[str, ...]]:
        words, k = self.text.split(), PHRASE_K if self.phrase else NOTICE_K
        return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


#: The phrases of the base digest, and the openings and whole texts of the usual public licenses.
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("gpl", 
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("apache", 
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license"),
    Template("mit", 
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction"),
    Template("bsd", 
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", 
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("gpl", 
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version"),
    Template("lgpl", 
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation either version 2 1 of the license or "
        "at your option any later version"),
    Template("apache", 
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless "
        "required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied see the license "
        "for the specific language governing permissions and limitations under the license"),
    Template("mit", 
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software and to permit persons to whom the software is furnished to do so subject to the following "
        "conditions the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software the software is provided as is without warranty of any kind express "
        "or implied including but not limited to the warranties of merchantability fitness for a particular "
        "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim "
        "damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software"),
    Template("bsd", 
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met redistributions of source code must retain the above copyright "
        "notice this list of conditions and the following disclaimer redistributions in binary form must reproduce "
        "the above copyright notice this list of conditions and the following disclaimer in the documentation and "
        "or other materials provided with the distribution this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied "
        "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
        "copyright holder or contributors be liable for any direct indirect incidental special exemplary or "
        "consequential damages including but not limited to procurement of substitute goods or services loss of "
        "use data or profits or business interruption however caused and on any theory of liability whether in "
        "contract strict liability or tort including negligence or otherwise arising in any way out of the use of "
        "this software even if advised of the possibility of such damage"),
    Template("mpl", 
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
        "was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    Template("isc", 
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness in no event shall the author be liable "
        "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of "
        "use data or profits whether in an action of contract negligence or other tortious action arising out of "
        "or in connection with the use or performance of this software"),
    Template("unlicense", 
        "this is free and unencumbered software released into the public domain anyone is free to copy modify "
        "publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means"),
)


def _grams(words: Column, k: int) -> Column:
    """Places and hashes of all rolling k-grams."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.struct(
        i.alias("at"), F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]).alias("gram"))))


def template_places(spark, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """template, place, k, gram, own for every k-gram of every template; ``own`` if no template of another label has it."""
    labels: dict[tuple[str, ...], set[str]] = {}
    for t in templates:
        for gram in t.grams:
            labels.setdefault(gram, set()).add(t.label)
    rows = [
        f"({i}, {place}, {len(gram)}, {str(len(labels[gram]) == 1).lower()}, array({', '.join(repr(w) for w in gram)}))"
        for i, t in enumerate(templates) for place, gram in enumerate(t.grams)]
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, place, k, own, words)")
    hashed = F.coalesce(*[F.when(F.col("k") == k, F.xxhash64(F.lit(k), *[F.get("words", F.lit(j)) for j in range(k)])) for k in (PHRASE_K, NOTICE_K)])
    return table.select("template", "place", "k", "own", hashed.alias("gram"))


def diagonals(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document, diagonal and stretch of a template that has votes: row, doc_id, n_words, template, diagonal,
    stretch, votes and own (bits), first, last (words, end exclusive). Documents without a vote have one row without a
    template."""
    words = F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    # a null one, so that every text stays
    empty = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("long").alias("gram")))
    none = F.array().cast("array<struct<at:int,gram:bigint>>")
    grams = F.concat(empty, *[F.coalesce(_grams(F.col("words"), k), none) for k in (PHRASE_K, NOTICE_K)])
    rolled = texts.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.inline(grams))
    voted = rolled.join(template_places(docs.sparkSession, templates), "gram", "left")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % BITS)
    seen = F.col("place").isNotNull()
    return voted.groupBy("row", "doc_id", "n_words", "template", (F.col("at") - F.col("place")).alias("diagonal"), F.floor(F.col("place") / BITS).alias("stretch")).agg(
        F.bit_or(bit).alias("votes"), F.bit_or(F.when(F.col("own"), bit)).alias("own"),
        F.min(F.when(seen, F.col("at"))).alias("first"), F.max(F.when(seen, F.col("at") + F.col("k"))).alias("last"))


def spans(votes: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Merge neighbouring diagonals and judge each copy: row, doc_id, n_words, label, phrase, first, last, coverage,
    verified. Documents without a vote keep their row."""
    labels: dict[tuple[str, ...], set[str]] = {}
    for t in templates:
        for gram in t.grams:
            labels.setdefault(gram, set()).add(t.label)
    facts = values(
        votes.sparkSession, [(i, len(t.text.split()), len(t.grams), sum(len(labels[g]) == 1 for g in t.grams), t.phrase) for i, t in enumerate(templates)],
        "of int, words int, places int, owned int, phrase boolean")
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    known = votes.join(facts, F.col("template") == F.col("of"), "left")
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.when(F.col("phrase"), 0).otherwise(NEAR)
    starts = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > near).cast("int"), F.lit(0))
    copies = known.withColumn("starts", starts).withColumn("copy", F.sum("starts").over(along))
    facts_of = ["row", "doc_id", "n_words", "template", "words", "places", "owned", "phrase", "copy"]
    stretches = copies.groupBy(*facts_of, "stretch").agg(
        F.bit_or("votes").alias("votes"), F.bit_or("own").alias("own"), F.min("first").alias("first"), F.max("last").alias("last"))
    merged = stretches.groupBy(*facts_of).agg(
        F.sum(F.bit_count("votes")).alias("votes"), F.sum(F.coalesce(F.bit_count("own"), F.lit(0))).alias("own"),
        F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.col("votes") / F.col("places")
    length = F.col("last") - F.col("first")
    verified = F.when(F.col("phrase"), covered == 1).otherwise(
        (covered >= COVERED) & (F.col("own") >= OWN * F.col("owned")) & (length <= F.col("words") * STRETCH))
    return merged.select(
        "row", "doc_id", "n_words", label.alias("label"), "phrase", "first", "last", covered.alias("coverage"),
        F.coalesce(verified, F.lit(False)).alias("verified"))


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best coverage of a verified span, 0 without one. A null or empty text has no words;
    texts shorter than a k-gram have no labels; a very long text is scanned whole; equal rows are separate
    documents; an empty table gives an empty result; columns other than doc_id and text are left out.
    """
    base, sure = F.col("verified") & F.col("phrase"), F.col("verified")

    def joined(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    found = spans(diagonals(docs)).groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(sure).alias("labels"),
        F.coalesce(F.max(F.when(sure, F.col("coverage"))), F.lit(0.0)).alias("score"),
    )
    return found.drop("row")
