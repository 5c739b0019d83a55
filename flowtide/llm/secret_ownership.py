"""Secret scans with corpus-wide ownership: who holds a candidate tells examples from live credentials.

Every text is scanned once; candidates are kept as kind, place and a hash of the value. The hashes are
counted by distinct repositories and owners over the whole corpus. A value that several owners hold, or two
of them in several repositories, is a copied example; any other that mixes its characters like a generated key
looks live, in however many repositories its one owner has it. Fixed kinds are always reported, generic runs
only where they look live.

Counts are aggregated stepwise, (hash, repository, owner), then (hash, owner), then hash, each with partial
sums before the shuffle, so a value that a third of all documents holds is a few rows, and only the hashes of
copied values go back to the places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.session import materialize


@dataclass(frozen=True)
class Kind:
    """A match counts if the group has at least this many characters."""

    name: str
    pattern: str
    group: int
    least: int


#: Kinds that are always reported, in the order of the listing; fixed values. Runs of a minimal length are
#: the runs of any length that pass it.
FIXED = (
    Kind(
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    Kind("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    Kind("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Runs that may be a key; reported only if they look live.
GENERIC = Kind("live", "[A-Za-z0-9_-]{20,}", 0, 20)
KINDS = (*FIXED, GENERIC)
#: Different characters a live-looking value has at least; owners from which on it is a copied example, and
#: repositories from which on two owners are enough.
LIVE_CHARACTERS, COPIED_OWNERS, COPIED_REPOSITORIES = 8, 3, 4

_SPAN = "struct<start:long,kind_no:int,kind:string,end:long>"
_NONE = "array<struct<kind_no:int,n:int,gap:long,length:long,hash:string,kept:boolean,looks_live:boolean>>"


def _looks_live(value: Column) -> Column:
    return (
        value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)
    )


def _pieces(text: Column, number: int, kind: Kind) -> Column:
    """Matches of one kind in order, each with the code points before it since the last one."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    cut = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.split(text, kind.pattern, -1).alias("before"))
    # the text after the last match comes as a piece without one
    matches = F.filter(cut, lambda p: p["whole"].isNotNull())

    def piece(p: Column, i: Column) -> Column:
        live = _looks_live(p["value"])
        kept = F.length(p["value"]) >= kind.least
        if kind is GENERIC:
            kept = kept & p["value"].rlike("[A-Z]") & p["value"].rlike("[a-z]") & live
        return F.struct(
            F.lit(number).alias("kind_no"), i.alias("n"), F.length(p["before"]).cast("long").alias("gap"), F.length(p["whole"]).cast("long").alias("length"),
            F.sha2(p["value"], 256).alias("hash"), kept.alias("kept"), live.alias("looks_live"))

    found = F.transform(matches, piece).cast(_NONE)
    return F.when(F.regexp_like(text, F.lit(kind.pattern)), found).otherwise(F.array().cast(_NONE))


def scanned(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One written row per document: row, doc_id, repository, owner, and pieces of all kinds, with the hash of
    each value in place of the value."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", repository.alias("repository"), owner.alias("owner"),
        F.concat(*[_pieces(text, i, kind) for i, kind in enumerate(KINDS)]).alias("pieces"))
    return materialize(found, "secrets")


def placed(found: DataFrame) -> DataFrame:
    """One written row per candidate: row, repository, owner, start, kind_no, kind, end, hash, looks_live. Offsets are
    running sums over the pieces of a text; generic runs that overlap a fixed kind are left out."""
    along = Window.partitionBy("row", "kind_no").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    pieces = found.where(F.size("pieces") > 0).select("row", "repository", "owner", F.inline("pieces"))
    ends = pieces.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(along)).where("kept")
    fixed = F.col("kind_no") < len(FIXED)
    # both run forward over their own order: a frame that shrinks would be summed up anew for every row
    text, upto = Window.partitionBy("row"), (Window.unboundedPreceding, 0)
    before = F.max(F.when(fixed, F.col("end"))).over(text.orderBy("start", "kind_no").rowsBetween(*upto))
    after = F.min(F.when(fixed, F.col("start"))).over(text.orderBy(F.col("start").desc(), F.col("kind_no").desc()).rowsBetween(*upto))
    spans = ends.withColumn("start", F.col("end") - F.col("length")).withColumns({"before": before, "after": after})
    free = F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    kind = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind_no") + 1)
    return materialize(
        spans.where(fixed | free).select("row", "repository", "owner", "start", "kind_no", kind.alias("kind"), "end", "hash", "looks_live"), "secret-spans")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, places, repositories, owners: how widely each value is held. A null owner is an owner."""
    pairs = spans.groupBy("hash", "repository", "owner").agg(F.count(F.lit(1)).alias("places"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("places").alias("places"), F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("hash").agg(
        F.sum("places").alias("places"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def is_copied() -> Column:
    """Of a row of ``ownership``: whether its value is a copied example."""
    owners = F.col("owners")
    return (owners >= COPIED_OWNERS) | ((owners > 1) & (F.col("repositories") >= COPIED_REPOSITORIES))


def secrets(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per document: doc_id, base, spans, n_live, n_copied.

    ``base`` holds the spans of the fixed kinds, ``spans`` those and the live generic runs, both by start, then
    kind. ``n_copied`` counts spans whose value is a copied example, ``n_live`` live-looking ones that are none.
    Without other columns given, the owner of a document is its source and the repository its source and language.

    A null text counts as empty; a very long text, or one with very many matches, is scanned whole in linear
    time; equal rows are separate documents; a value found twice in a text is two spans; an empty table gives an
    empty result; other columns are left out.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    found = scanned(docs, repository, owner)
    spans = placed(found)
    copied = ownership(spans).where(is_copied()).select("hash", F.lit(True).alias("known"))
    judged = spans.join(copied, "hash", "left").withColumn("copied", F.coalesce("known", F.lit(False)))
    live = F.col("looks_live") & ~F.col("copied")
    fixed = F.col("kind_no") < len(FIXED)
    span = F.struct("start", "kind_no", "kind", "end")
    by_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(fixed, span))).alias("base"), F.array_sort(F.collect_list(F.when(fixed | live, span))).alias("spans"),
        F.count_if(live).alias("n_live"), F.count_if("copied").alias("n_copied"))
    joined = found.select("row", "doc_id").join(by_row, "row", "left")
    none = F.array().cast(f"array<{_SPAN}>")
    return joined.select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def kinds_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


#: The same over whole tables in SQL.
SQL = r"""
WITH kinds(kind_no, kind, pattern, grp, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 18), (2, 'hex', '[0-9a-f]+', 0, 16), (3, 'live', '[A-Za-z0-9_-]+', 0, 20)),
d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT rid, kind_no, kind, least, source, lang, i, list_sum(list_transform(between_[1 : i], lambda x: length(x))) AS gaps,
         coalesce(list_sum(list_transform(whole[1 : i - 1], lambda x: length(x))), 0) AS earlier, length(whole[i]) AS n, value[i] AS value
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
    SELECT rid, kind_no, kind, least, source, lang, string_split_regex(text, p) AS between_,
           regexp_extract_all(text, p, 0) AS whole,
           CASE WHEN grp = 2 THEN regexp_extract_all(text, p, 2) ELSE regexp_extract_all(text, p, 0) END AS value
    FROM (SELECT *, '[0-9a-f]{16,}' AS p FROM d, kinds WHERE kind_no = 2
          UNION ALL SELECT *, '[A-Za-z0-9_-]{20,}' AS p FROM d, kinds WHERE kind_no = 3
          UNION ALL SELECT *, pattern AS p FROM d, kinds WHERE kind_no < 2)))
),
spans AS (
  SELECT *, CAST(gaps + earlier AS BIGINT) AS start, CAST(gaps + earlier + n AS BIGINT) AS stop,
         regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
           AND len(list_distinct(string_split(value, ''))) >= 8 AS looks_live
  FROM m WHERE length(value) >= least
),
candidates AS (
  SELECT * FROM spans s WHERE kind_no < 3 OR (
    looks_live AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND NOT EXISTS (
      SELECT 1 FROM spans b WHERE b.rid = s.rid AND b.kind_no < 3 AND s.start < b.stop AND b.start < s.stop))
),
owners AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners,
                  count(DISTINCT (coalesce('=' || source, ''), coalesce('=' || lang, ''))) AS repositories FROM candidates GROUP BY value),
told AS (SELECT value, owners >= 3 OR (owners > 1 AND repositories >= 4) AS copied FROM owners),
judged AS (SELECT c.*, looks_live AND NOT copied AS live, copied FROM candidates c JOIN told USING (value)),
by_row AS (
  SELECT rid, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
         count(*) FILTER (kind_no = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < 3 OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM judged GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN by_row USING (rid)
"""
