"""Text and document expressions for enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mention pattern, context width, keyword table (checked in this order), scores.
CVE_PATTERN = r"CVE-\d{4}-\d{4,7}"
CONTEXT_CHARS = 200
SEVERITY_KEYWORDS = {
    "CRITICAL": ["critical", "severe", "rce", "remote code execution"],
    "HIGH": ["high", "dangerous", "dos", "denial of service"],
    "MEDIUM": ["medium", "moderate", "xss", "csrf"],
    "LOW": ["low", "minor", "local"],
}
DEFAULT_SEVERITY = "MEDIUM"
SCORE_RANGES = {"CRITICAL": "9.0-10.0", "HIGH": "7.0-8.9", "MEDIUM": "4.0-6.9", "LOW": "0.1-3.9"}
CVE_URL = "https://nvd.nist.gov/vuln/detail/"
SEARCH_URL = "https://www.google.com/search?q="
ENTERPRISE_TERMS = ["enterprise", "professional", "business", "corporate", "industry"]


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def clean_for_relevance(text: Column, longest: int | None = None) -> Column:
    """Plain ASCII words and punctuation: what follows ``Final Prediction:``, else the first
    line, with ``longest`` at most that many characters of it."""
    ascii_only = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    plain = F.regexp_replace(ascii_only, r"[^\w\s.,:;!?-]", "")
    found = F.regexp_extract(plain, r"Final Prediction:\s*([^\n]+)", 1)
    first_line = F.element_at(F.split(strip(plain), "\n"), 1)
    first_line = first_line if longest is None else F.substring(first_line, 1, longest)
    return F.when(text.isNull(), F.lit("")).when(found != "", strip(found)).otherwise(first_line)


def severity_from_text(text: Column) -> Column:
    """First severity one of whose keywords occurs anywhere in the text."""
    low = F.lower(text)
    chain = None
    for severity, words in SEVERITY_KEYWORDS.items():
        hit = F.contains(low, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(low, F.lit(word))
        chain = F.when(hit, F.lit(severity)) if chain is None else chain.when(hit, F.lit(severity))
    return chain.otherwise(F.lit(DEFAULT_SEVERITY))


def score_range(severity: Column) -> Column:
    chain = None
    for name, span in SCORE_RANGES.items():
        chain = F.when(severity == name, span) if chain is None else chain.when(severity == name, span)
    return chain.otherwise("N/A")


def _total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, s: acc + F.length(s))


def mine_mentions(
    df: DataFrame, text: str, topic: Column, pattern: str = CVE_PATTERN, limit: int | None = None
) -> DataFrame:
    """One row per distinct id mentioned in a text, in order of first mention (with
    ``limit``, the first so many of each text): context, severity, description.

    The text is split at the matches once; a match starts after the pieces and matches before
    it, so ids that are the beginning of a longer id are never mistaken for it.
    """
    matched = df.withColumns(
        {
            "__ids": F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)),
            "__pieces": F.split(F.col(text), pattern, -1),
        }
    )
    distinct = F.array_distinct("__ids")
    chosen = distinct if limit is None else F.slice(distinct, 1, limit)
    mentions = (
        matched.select("*", F.posexplode_outer(chosen).alias("ordinal", "mention"))
        .where(F.col("mention").isNotNull())
        .withColumn("__at", F.array_position("__ids", F.col("mention")).cast("int"))
        .withColumn(
            "start",
            _total_length(F.slice("__pieces", F.lit(1), F.col("__at")))
            + _total_length(F.slice("__ids", F.lit(1), F.col("__at") - 1)),
        )
        .withColumn("__from", F.greatest(F.col("start") - CONTEXT_CHARS, F.lit(0)))
        .withColumn(
            "context",
            F.substring(
                F.col(text),
                F.col("__from") + 1,
                F.col("start") + F.length("mention") + CONTEXT_CHARS - F.col("__from"),
            ),
        )
        .withColumn("__sentences", F.split("context", r"[.!?]+", -1))
        .withColumn(
            "__hit",
            F.array_position(F.transform("__sentences", lambda s: F.contains(s, F.col("mention"))), F.lit(True)).cast("int"),
        )
    )
    here = strip(F.get("__sentences", F.col("__hit") - 1))
    following = F.get("__sentences", F.col("__hit"))
    described = F.when(following.isNotNull(), F.concat(here, F.lit(". "), strip(following))).otherwise(here)
    placeholder = F.concat(F.lit("Vulnerability related to "), topic, F.lit(" attacks"))
    return (
        mentions.withColumn("severity", severity_from_text(F.col("context")))
        .withColumns(
            {
                "description": F.when((F.col("__hit") > 0) & (described != ""), described).otherwise(placeholder),
                "score": score_range(F.col("severity")),
                "url": F.concat(F.lit(CVE_URL), "mention"),
            }
        )
        .drop("__ids", "__pieces", "__at", "__from", "__sentences", "__hit")
    )


def cve_rows(parsed: DataFrame, keep: list[str], variant: str = "A") -> DataFrame:
    """CVE records to rows. Variant A grades V2 scores and fills missing text; variant B drops
    records without an English description."""
    cve = F.col("record.cve")
    metrics = cve["metrics"]
    v31, v30, v2 = metrics["cvssMetricV31"], metrics["cvssMetricV30"], metrics["cvssMetricV2"]
    english = F.get(F.filter(cve["descriptions"], lambda d: d["lang"] == "en"), F.lit(0))["value"]
    valid = parsed.where(cve["id"].rlike(r"\ACVE-\d{4}-\d{4,7}\z"))

    def first(metric: Column) -> Column:
        return F.get(metric, F.lit(0))["cvssData"]

    if variant == "A":
        has31, has30, has2 = F.size(v31) > 0, F.size(v30) > 0, F.size(v2) > 0
        score2 = F.coalesce(first(v2)["baseScore"], F.lit("0"))
        graded = F.when(score2.cast("double") >= 7.0, "HIGH").when(score2.cast("double") >= 4.0, "MEDIUM").otherwise("LOW")
        severity = (
            F.when(has31, F.coalesce(first(v31)["baseSeverity"], F.lit("UNKNOWN")))
            .when(has30, F.coalesce(first(v30)["baseSeverity"], F.lit("UNKNOWN")))
            .when(has2, graded)
            .otherwise("UNKNOWN")
        )
        score = (
            F.when(has31, F.coalesce(first(v31)["baseScore"], F.lit("N/A")))
            .when(has30, F.coalesce(first(v30)["baseScore"], F.lit("N/A")))
            .when(has2, score2)
            .otherwise("N/A")
        )
        description = F.coalesce(english, F.lit("No description available"))
    elif variant == "B":
        chosen = F.when(v31.isNotNull(), v31).when(v30.isNotNull(), v30).otherwise(v2)
        valid = valid.where((F.coalesce(english, F.lit("")) != "") & (chosen.isNull() | (F.size(chosen) > 0)))
        severity = F.coalesce(first(chosen)["baseSeverity"], F.lit("N/A"))
        score = F.coalesce(first(chosen)["baseScore"], F.lit("N/A"))
        description = english
    else:
        raise ValueError("variant is 'A' or 'B'")
    return valid.select(
        *keep,
        cve["id"].alias("id"),
        F.concat(F.lit(CVE_URL), cve["id"]).alias("url"),
        severity.alias("severity"),
        score.alias("score"),
        description.alias("description"),
    )


def paper_columns(title: Column, authors: Column, entry_id: Column, published: Column, content: Column) -> dict[str, Column]:
    """Paper metadata with defaults; the id is the last part of the entry address."""
    entry = F.coalesce(entry_id, F.lit(""))
    return {
        "title": F.coalesce(title, F.lit("Unknown Title")),
        "authors": F.coalesce(authors, F.lit("Unknown Authors")),
        "arxiv_id": F.when(entry == "", "unknown").otherwise(F.element_at(F.split(entry, "/"), -1)),
        "url": entry,
        "published": F.coalesce(F.nullif(published, F.lit("")), F.lit("Unknown")),
        "summary": F.coalesce(content, F.lit("No summary available")),
    }


def product_relevance(name: Column, kind: Column, description: Column, need: Column) -> Column:
    """3 for the name, 2 for the type and 2 for the description holding a word of the need,
    1 for an enterprise term in the description."""
    words = F.filter(F.split(F.lower(need), r"\s+"), lambda w: w != "")

    def holds(text: Column) -> Column:
        low = F.lower(text)
        return F.exists(words, lambda w: F.contains(low, w))

    low = F.lower(description)
    enterprise = F.contains(low, F.lit(ENTERPRISE_TERMS[0]))
    for term in ENTERPRISE_TERMS[1:]:
        enterprise = enterprise | F.contains(low, F.lit(term))
    return (
        F.when(holds(name), 3).otherwise(0)
        + F.when(holds(kind), 2).otherwise(0)
        + F.when(holds(description), 2).otherwise(0)
        + F.when(enterprise, 1).otherwise(0)
    )


def _flavour(attack: Column, icmp: Column, benign: Column, other: Column) -> Column:
    low = F.lower(attack)
    return F.when(low == "icmp flood", icmp).when(low == "benign", benign).otherwise(other)


def paper_query(attack: Column) -> Column:
    """Literature query for an attack type."""
    # Query texts.
    return _flavour(
        attack,
        F.lit('cat:cs.CR AND (ti:"DDoS" OR ti:"denial of service" OR abs:"ICMP flood")'),
        F.lit('cat:cs.CR AND (ti:"network traffic classification" OR ti:"intrusion detection")'),
        F.concat(F.lit('cat:cs.CR AND (ti:"'), attack, F.lit('" OR abs:"'), attack, F.lit('")')),
    )


PAPER_FALLBACK_QUERY = 'cat:cs.CR AND (ti:"network security" OR ti:"intrusion detection")'


def _clean_topic(attack: Column) -> Column:
    return F.regexp_replace(attack, r"[^\w\s-]", "")


def cve_query(attack: Column) -> Column:
    """Quoted keywords joined by OR; null for benign traffic, which is not looked up."""
    topic = _clean_topic(attack)
    # Keyword lists.
    terms = _flavour(
        topic,
        F.array(F.lit("ICMP flood"), F.lit("ping flood"), F.lit("ICMP DoS")),
        F.lit(None),
        F.array(topic, F.lit("network attack"), F.lit("network security")),
    )
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def mention_search_terms(attack: Column) -> Column:
    """Search terms whose results are mined for mentions when the feed has nothing."""
    topic = _clean_topic(attack)
    # Search terms and the sites they are limited to.
    sites = " site:cve.mitre.org OR site:nvd.nist.gov"
    terms = _flavour(
        topic,
        F.array(F.lit("ICMP flood vulnerability"), F.lit("ping flood CVE"), F.lit("ICMP DoS attack CVE")),
        F.slice(F.array(F.lit("")), 1, 0),
        F.array(F.concat(topic, F.lit(" CVE vulnerability")), F.concat(topic, F.lit(" security exploit"))),
    )
    return F.transform(terms, lambda t: F.concat(t, F.lit(sites)))


def product_query(attack: Column) -> Column:
    # Product query texts.
    return _flavour(
        attack,
        F.lit("DDoS and ICMP flood protection"),
        F.lit("network monitoring and intrusion detection"),
        F.concat(attack, F.lit(" attack prevention")),
    )


def product_search_terms(query: Column) -> Column:
    """Three search terms for a product query."""
    attack = F.trim(F.replace(query, F.lit(" attack prevention"), F.lit("")))
    # Search terms.
    return F.when(
        F.contains(F.lower(query), F.lit("attack prevention")),
        F.array(
            F.concat(F.lit("cybersecurity products "), attack, F.lit(" protection")),
            F.lit("network security solutions enterprise"),
            F.lit("intrusion detection prevention systems"),
        ),
    ).otherwise(
        F.array(
            F.concat(F.lit("cybersecurity products "), query),
            F.lit("enterprise security solutions"),
            F.lit("network security vendors comparison"),
        )
    )


def fallback_topic(query: Column) -> Column:
    """Which fallback catalogue answers a product query."""
    low = F.lower(query)
    return (
        F.when(F.contains(low, F.lit("ddos")) | F.contains(low, F.lit("icmp")), "flood")
        .when(F.contains(low, F.lit("dictionary")) | F.contains(low, F.lit("brute force")), "password")
        .otherwise("general")
    )


def strip_code_fence(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"\A```json\s*|\s*```\z", "")


def default_search_url(name: Column) -> Column:
    return F.concat(F.lit(SEARCH_URL), F.replace(name, F.lit(" "), F.lit("+")))


def chunk_text(df: DataFrame, text: str, keep: list[str], size: int = 500, overlap: int = 50) -> DataFrame:
    """Fixed-width chunks with overlap, as one row each."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0)).cast("int")
    starts = F.sequence(F.lit(0), last)
    return df.where(F.length(text) > 0).select(
        *keep,
        F.posexplode_outer(F.transform(starts, lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))).alias("chunk_no", "chunk"),
    )


def traffic_badge(prediction: Column) -> Column:
    """Report colour of a prediction."""
    # Badge colours.
    return F.when(prediction == "Malicious", "red").when(prediction == "Suspicious", "yellow").otherwise("green")


def severity_badge(severity: Column) -> Column:
    # Badge colours.
    return (
        F.when(severity == "CRITICAL", "red-600")
        .when(severity == "HIGH", "orange-500")
        .when(severity == "MEDIUM", "amber-500")
        .when(severity == "LOW", "blue-500")
        .otherwise("gray-500")
    )
