"""Named queries over documents, search results, products and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions import text
from flowtide.functions.flow import two_decimals
from flowtide.operators import matching, rules, voting
from flowtide.plans import report
from flowtide.plans.registry import query
from flowtide.session import fresh_path, table
from flowtide.sources import adapters, files, knowledge


@query(
    "clean_text",
    r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('Notes: Final Prediction:  ', text) ELSE text END AS t FROM documents),
        p AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[^\x00-\x7F]', '', 'g'), '[^\w\s.,:;!?-]', '', 'g') AS t FROM d)
        SELECT doc_id, CASE WHEN regexp_extract(t, 'Final Prediction:\s*([^\n]+)', 1) <> ''
          THEN regexp_replace(regexp_extract(t, 'Final Prediction:\s*([^\n]+)', 1), '^\s+|\s+$', '', 'g')
          ELSE substr(split_part(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(10), 1), 1, 200) END AS cleaned FROM p""",
)
def clean_text(spark, folder):
    marked = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Notes: Final Prediction:  "), "text")).otherwise(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", text.clean_for_relevance(marked, 200).alias("cleaned"))


def _severity_sql(column: str) -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains({column}, {word!r})' for word in words)} THEN '{name}'"
        for name, words in text.SEVERITY_KEYWORDS.items()
    )
    return f"CASE {cases} ELSE 'MEDIUM' END"


@query(
    "severity_keywords",
    f"""SELECT doc_id, severity, CASE severity WHEN 'CRITICAL' THEN '9.0-10.0' WHEN 'HIGH' THEN '7.0-8.9' WHEN 'MEDIUM' THEN '4.0-6.9' ELSE '0.1-3.9' END AS score
        FROM (SELECT doc_id, {_severity_sql('lower(text)')} AS severity FROM documents)""",
)
def severity_keywords(spark, folder):
    graded = table(spark, folder, "documents").select("doc_id", text.severity_from_text(F.col("text")).alias("severity"))
    return graded.withColumn("score", text.score_range(F.col("severity")))


# Ids of the mined kind do not occur in the documents, so the query mines capitalised long words.
_MENTION = "[A-Z][a-z]{6,}"


@query(
    "mention_context",
    rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{_MENTION}') AS ids, string_split_regex(text, '{_MENTION}') AS pieces FROM documents),
        m AS (SELECT doc_id, unnest(ids) AS mention, generate_subscripts(ids, 1) AS pos FROM d),
        f AS (SELECT doc_id, mention, min(pos) AS pos FROM m GROUP BY doc_id, mention),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ordinal FROM f),
        s AS (SELECT r.doc_id, mention, ordinal, text, CAST(coalesce(list_sum(list_transform(pieces[1:pos], lambda x: length(x))), 0)
               + coalesce(list_sum(list_transform(ids[1:pos - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM r JOIN d ON r.doc_id = d.doc_id WHERE ordinal < 5),
        c AS (SELECT *, substr(text, greatest(start - 200, 0) + 1, start + length(mention) + 200 - greatest(start - 200, 0)) AS context FROM s),
        t AS (SELECT *, string_split_regex(context, '[.!?]+') AS sents FROM c),
        h AS (SELECT *, list_position(list_transform(sents, lambda x: contains(x, mention)), true) AS hit FROM t)
        SELECT doc_id, CAST(ordinal AS INT) AS ordinal, mention, CAST(start AS INT) AS start, {_severity_sql('lower(context)')} AS severity,
          concat(regexp_replace(sents[hit], '^\s+|\s+$', '', 'g'), CASE WHEN hit < len(sents) THEN concat('. ', regexp_replace(sents[hit + 1], '^\s+|\s+$', '', 'g')) ELSE '' END) AS description
        FROM h""",
)
def mention_context(spark, folder):
    mined = text.mine_mentions(table(spark, folder, "documents"), "text", F.lit("network"), _MENTION, 5)
    return mined.select("doc_id", "ordinal", "mention", "start", "severity", "description")


_CVE_SQL = """SELECT doc_id, json_extract_string(raw_json, '$.cve.id') AS id, json_extract_string(raw_json, '$.cve.descriptions[0].lang') AS lang,
    json_extract_string(raw_json, '$.cve.descriptions[0].value') AS value,
    json_extract_string(raw_json, '$.cve.metrics.cvssMetricV2[0].cvssData.baseScore') AS v2,
    coalesce(json_extract_string(raw_json, '$.cve.metrics.cvssMetricV31[0].cvssData.baseScore'),
      json_extract_string(raw_json, '$.cve.metrics.cvssMetricV30[0].cvssData.baseScore')) AS v3 FROM cve_feed"""


@query(
    "cve_rows",
    f"""SELECT doc_id, id, concat('https://nvd.nist.gov/vuln/detail/', id) AS url,
          CASE WHEN v3 IS NOT NULL THEN 'UNKNOWN' WHEN CAST(v2 AS DOUBLE) >= 7 THEN 'HIGH' WHEN CAST(v2 AS DOUBLE) >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
          coalesce(v3, v2) AS score, CASE WHEN lang = 'en' THEN value ELSE 'No description available' END AS description
        FROM ({_CVE_SQL}) WHERE regexp_full_match(id, 'CVE-[0-9]{{4}}-[0-9]{{4,7}}')""",
    "cve_feed",
)
def cve_rows(spark, folder):
    return text.cve_rows(files.parse_cve_feed(adapters.cve_feed(spark, folder)), ["doc_id"], "A")


@query(
    "cve_rows_strict",
    f"""SELECT doc_id, id, concat('https://nvd.nist.gov/vuln/detail/', id) AS url, 'N/A' AS severity, coalesce(v3, v2) AS score, value AS description
        FROM ({_CVE_SQL}) WHERE regexp_full_match(id, 'CVE-[0-9]{{4}}-[0-9]{{4,7}}') AND lang = 'en'""",
    "cve_feed",
)
def cve_rows_strict(spark, folder):
    return text.cve_rows(files.parse_cve_feed(adapters.cve_feed(spark, folder)), ["doc_id"], "B")


@query(
    "first_per_query",
    f"""SELECT severity, id FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY doc_id) AS rn FROM
         (SELECT doc_id, id, CASE WHEN v3 IS NOT NULL THEN 'UNKNOWN' WHEN CAST(v2 AS DOUBLE) >= 7 THEN 'HIGH' WHEN CAST(v2 AS DOUBLE) >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity
          FROM ({_CVE_SQL}) WHERE regexp_full_match(id, 'CVE-[0-9]{{4}}-[0-9]{{4,7}}'))) WHERE rn <= 5""",
    "cve_feed",
)
def first_per_query(spark, folder):
    rows = text.cve_rows(files.parse_cve_feed(adapters.cve_feed(spark, folder)), ["doc_id"], "A")
    return matching.first_per_query(rows, "severity", [F.col("doc_id")]).select("severity", "id")


@query(
    "cve_preview",
    f"""WITH c AS (SELECT doc_id, id, CASE WHEN v3 IS NOT NULL THEN 'UNKNOWN' WHEN CAST(v2 AS DOUBLE) >= 7 THEN 'HIGH' WHEN CAST(v2 AS DOUBLE) >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity
          FROM ({_CVE_SQL}) WHERE regexp_full_match(id, 'CVE-[0-9]{{4}}-[0-9]{{4,7}}')),
        r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY severity) AS n FROM c)
        SELECT severity, string_agg(id, ', ' ORDER BY rn) FILTER (rn <= 3) AS shown, CAST(greatest(max(n) - 3, 0) AS BIGINT) AS more,
          CASE severity WHEN 'HIGH' THEN 'orange-500' WHEN 'MEDIUM' THEN 'amber-500' WHEN 'LOW' THEN 'blue-500' ELSE 'gray-500' END AS badge
        FROM r GROUP BY severity""",
    "cve_feed",
)
def cve_preview(spark, folder):
    rows = text.cve_rows(files.parse_cve_feed(adapters.cve_feed(spark, folder)), ["doc_id"], "A")
    return report.preview(rows, "severity", "id", [F.col("doc_id")]).withColumn("badge", text.severity_badge(F.col("severity")))


@query(
    "paper_rows",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Unknown Title' ELSE concat('Study ', CAST(page_id AS VARCHAR)) END AS title,
         CASE WHEN page_id % 7 = 0 THEN 'Unknown Authors' ELSE 'A. Writer' END AS authors,
         CASE WHEN page_id % 11 = 0 THEN 'unknown' ELSE string_split(url, '/')[-1] END AS arxiv_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE url END AS url,
         CASE WHEN page_id % 3 = 0 THEN 'Unknown' ELSE '2024-01-02' END AS published, CAST(length(html) AS INT) AS summary_chars FROM pages""",
)
def paper_rows(spark, folder):
    page = F.col("page_id")
    columns = text.paper_columns(
        F.when(page % 5 != 0, F.concat(F.lit("Study "), page.cast("string"))),
        F.when(page % 7 != 0, F.lit("A. Writer")),
        F.when(page % 11 != 0, F.col("url")),
        F.when(page % 3 != 0, F.lit("2024-01-02")),
        F.col("html"),
    )
    papers = table(spark, folder, "pages").select("page_id", *[c.alias(n) for n, c in columns.items()])
    return papers.withColumn("summary_chars", F.length("summary")).drop("summary")


_NEED = "enterprise small ring protection"
_SCORE_SQL = """SELECT product_id, name, CAST(CASE WHEN {name} THEN 3 ELSE 0 END + CASE WHEN {type} THEN 2 ELSE 0 END + CASE WHEN {description} THEN 2 ELSE 0 END
    + CASE WHEN contains(lower(description), 'enterprise') OR contains(lower(description), 'professional') OR contains(lower(description), 'business')
        OR contains(lower(description), 'corporate') OR contains(lower(description), 'industry') THEN 1 ELSE 0 END AS INT) AS relevance FROM products""".format(
    **{c: " OR ".join(f"contains(lower({c}), '{w}')" for w in _NEED.split()).join("()") for c in ("name", "type", "description")}
)


def _scored(spark, folder):
    return adapters.products(spark, folder).withColumn(
        "relevance", text.product_relevance(F.col("name"), F.col("type"), F.col("description"), F.lit(_NEED))
    )


@query("relevance_score", _SCORE_SQL.replace("product_id, name,", "product_id,"), "products")
def relevance_score(spark, folder):
    return _scored(spark, folder).select("product_id", "relevance")


@query("top_products", f"SELECT product_id, relevance FROM ({_SCORE_SQL})", "products")
def top_products(spark, folder):
    return _scored(spark, folder).orderBy(F.col("relevance").desc(), "product_id").select("product_id", "relevance")


@query("score_products", f"SELECT product_id, name, relevance FROM ({_SCORE_SQL})", "products")
def score_products(spark, folder):
    """Scored products in their given order."""
    return _scored(spark, folder).orderBy("product_id").select("product_id", "name", "relevance")


@query(
    "union_results",
    "SELECT CAST(0 AS INT) AS batch, url FROM pages UNION ALL SELECT CAST(1 AS INT), concat('Vendor ', CAST(page_id % 40 AS VARCHAR)) FROM pages",
)
def union_results(spark, folder):
    pages = table(spark, folder, "pages")
    return matching.union_results(
        [pages.select("url"), pages.select(F.concat(F.lit("Vendor "), (F.col("page_id") % 40).cast("string")).alias("url"))]
    )


_BLOCK_SQL = """SELECT block_id, lower(regexp_extract(block, 'Title: ([^\n]*)', 1)) AS title, regexp_extract(block, 'URL: ([^\n]*)', 1) AS url FROM search_blocks"""


@query(
    "parse_blocks",
    f"SELECT title, arg_max(url, block_id) AS url FROM ({_BLOCK_SQL}) GROUP BY title",
    "search_blocks",
)
def parse_blocks(spark, folder):
    parsed = matching.parse_blocks(adapters.search_blocks(spark, folder), "block", ["block_id"])
    return matching.title_map(parsed).select("title", "url")


@query(
    "last_wins_map",
    f"SELECT title, arg_max(url, block_id) AS last_url, arg_min(url, block_id) AS first_url FROM ({_BLOCK_SQL}) GROUP BY title",
    "search_blocks",
)
def last_wins_map(spark, folder):
    parsed = matching.parse_blocks(adapters.search_blocks(spark, folder), "block", ["block_id"])
    return parsed.groupBy("title").agg(F.max_by("url", "place").alias("last_url"), F.min_by("url", "place").alias("first_url"))


_TITLES_SQL = """SELECT block_id, lower(title) AS title, url FROM (
    SELECT p_partkey AS block_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE concat(p_type, ' ', p_brand, ' ', p_name) END AS title,
      concat('http://shop.example.com/', CAST(p_partkey AS VARCHAR)) AS url FROM part)"""


@query(
    "fuzzy_match",
    f"""WITH t AS (SELECT title, arg_max(url, block_id) AS url, min(block_id) AS seen FROM ({_TITLES_SQL}) GROUP BY title),
        n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT concat('the ', p_type) FROM part UNION SELECT s_name FROM supplier
              UNION SELECT replace(p_name, ' ', '') FROM part),
        e AS (SELECT n.name, arg_min(t.url, t.seen) AS u FROM n JOIN t ON lower(n.name) = t.title GROUP BY n.name),
        p AS (SELECT n.name, arg_min(t.url, t.seen) AS u FROM n JOIN t ON contains(replace(t.title, ' ', ''), replace(lower(n.name), ' ', ''))
                OR len(list_filter(string_split(lower(n.name), ' '), lambda w: length(w) > 3 AND contains(t.title, w))) > 0 GROUP BY n.name)
        SELECT n.name, coalesce(e.u, p.u, concat('https://www.google.com/search?q=', replace(n.name, ' ', '+'))) AS url
        FROM n LEFT JOIN e ON n.name = e.name LEFT JOIN p ON n.name = p.name""",
)
def fuzzy_match(spark, folder):
    """Product, category and vendor names against the titles of search results."""
    part = table(spark, folder, "part")
    heading = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_type", "p_brand", "p_name"))
    blocks = part.select(
        F.col("p_partkey").alias("block_id"),
        F.concat(F.lit("Title: "), heading, F.lit("\nURL: http://shop.example.com/"), F.col("p_partkey").cast("string"), F.lit("\n")).alias("block"),
    )
    titles = matching.title_map(matching.parse_blocks(blocks, "block", ["block_id"]))
    names = (
        part.select(F.col("p_name").alias("name"))
        .union(part.select(F.concat(F.lit("the "), "p_type")))
        .union(table(spark, folder, "supplier").select("s_name"))
        .union(part.select(F.replace("p_name", F.lit(" "), F.lit(""))))
    )
    return matching.match_urls(names, titles)


@query(
    "enrichment_queries",
    """SELECT flow_id,
      CASE lower(label) WHEN 'icmp flood' THEN 'cat:cs.CR AND (ti:"DDoS" OR ti:"denial of service" OR abs:"ICMP flood")'
        WHEN 'benign' THEN 'cat:cs.CR AND (ti:"network traffic classification" OR ti:"intrusion detection")'
        ELSE concat('cat:cs.CR AND (ti:"', label, '" OR abs:"', label, '")') END AS paper_query,
      CASE lower(label) WHEN 'icmp flood' THEN '"ICMP flood" OR "ping flood" OR "ICMP DoS"' WHEN 'benign' THEN '-'
        ELSE concat('"', label, '" OR "network attack" OR "network security"') END AS cve_query,
      CASE lower(label) WHEN 'icmp flood' THEN 'DDoS and ICMP flood protection' WHEN 'benign' THEN 'network monitoring and intrusion detection'
        ELSE concat(label, ' attack prevention') END AS product_query,
      CASE lower(label) WHEN 'icmp flood' THEN 'cybersecurity products DDoS and ICMP flood protection'
        WHEN 'benign' THEN 'cybersecurity products network monitoring and intrusion detection'
        ELSE concat('cybersecurity products ', label, ' protection') END AS first_product_term,
      CAST(CASE lower(label) WHEN 'icmp flood' THEN 3 WHEN 'benign' THEN 0 ELSE 2 END AS INT) AS n_mention_terms FROM flows""",
    "flows",
)
def enrichment_queries(spark, folder):
    label = F.col("label")
    return (
        adapters.flows(spark, folder)
        .select(
            "flow_id",
            text.paper_query(label).alias("paper_query"),
            F.coalesce(text.cve_query(label), F.lit("-")).alias("cve_query"),
            text.product_query(label).alias("product_query"),
            F.size(text.mention_search_terms(label)).alias("n_mention_terms"),
        )
        .withColumn("first_product_term", text.product_search_terms(F.col("product_query"))[0])
    )


_CATALOGUE_SQL = "(VALUES " + ", ".join(
    f"('{topic}', '{name}', {score})" for topic, name, _, _, _, score in report.FALLBACK_PRODUCTS
) + ") c(topic, name, relevance_score)"


@query(
    "fallback_products",
    f"""SELECT flow_id, name, CAST(relevance_score AS DOUBLE) AS relevance_score FROM
         (SELECT flow_id, CASE label WHEN 'ICMP Flood' THEN 'flood' WHEN 'Dictionary Attack' THEN 'password' ELSE 'general' END AS topic FROM flows) f
         JOIN {_CATALOGUE_SQL} ON f.topic = c.topic""",
    "flows",
)
def fallback_products(spark, folder):
    asked = adapters.flows(spark, folder).select("flow_id", text.product_query(F.col("label")).alias("q"))
    return report.fallback_products(asked, "q").select("flow_id", "name", "relevance_score")


@query(
    "json_products",
    """SELECT product_id, concat(name, ' ', CAST(i AS VARCHAR)) AS name, CAST(product_id % 13 + i AS DOUBLE) AS relevance_score,
         concat_ws(',', CASE WHEN length(concat(description, CASE WHEN i = 0 THEN ' with inspection of all traffic' ELSE '' END)) NOT BETWEEN 50 AND 500 THEN 'description' END,
           CASE WHEN product_id % 13 + i > 10 THEN 'relevance_score' END) AS errors
       FROM products, (SELECT unnest([0, 1]) AS i)""",
    "products",
)
def json_products(spark, folder):
    """Fenced JSON answers, parsed and checked product by product."""

    def item(i: int, tail: str):
        return F.concat(
            F.lit('{"name":"'), "name", F.lit(f' {i}","type":"'), "type", F.lit('","description":"'), "description",
            F.lit(f'{tail}","relevance_score":'), (F.col("product_id") % 13 + i).cast("string"), F.lit("}"),
        )

    answers = adapters.products(spark, folder).select(
        "product_id",
        F.concat(F.lit("```json\n["), item(0, " with inspection of all traffic"), F.lit(","), item(1, ""), F.lit("]\n```")).alias("answer"),
    )
    checked = rules.validate_products(report.json_products(answers, "answer", ["product_id"]))
    return checked.select("product_id", "name", "relevance_score", F.array_join("errors", ",").alias("errors"))


@query(
    "chunk_text",
    """SELECT doc_id, CAST(i AS INT) AS chunk_no, substr(text, i * 450 + 1, 500) AS chunk FROM
         (SELECT doc_id, text, unnest(range(greatest(CAST(ceil((length(text) - 50) / 450) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)""",
)
def chunk_text(spark, folder):
    return text.chunk_text(table(spark, folder, "documents"), "text", ["doc_id"])


@query("chunk_text_separators")
def chunk_text_separators(spark, folder):
    """Chunks that break at paragraphs, lines and words before they break inside a word."""
    return knowledge.chunk_at_separators(table(spark, folder, "documents"), "text", ["doc_id"])


@query(
    "knowledge_append",
    """SELECT doc_id, CAST(greatest(CAST(ceil((length(text) - 50) / 450) AS BIGINT), 1) AS BIGINT) AS n_chunks, 1.0::DOUBLE AS norm FROM documents WHERE length(text) > 0""",
)
def knowledge_append(spark, folder):
    """Documents added to the knowledge table in two appends, then sized per document."""
    path = fresh_path(spark, "knowledge")
    documents = table(spark, folder, "documents").where(F.length("text") > 0)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for part in (documents.where(english), documents.where(~english)):
        knowledge.add_knowledge(part, "text", "doc_id", path)
    stored = knowledge.load_knowledge(spark, path)
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    # A chunk without any word has no direction and stays all zeros.
    length = F.when(square > 0, F.round(F.sqrt(square), 4)).otherwise(F.lit(1.0))
    return stored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(length).alias("norm"))


# -- report ------------------------------------------------------------------------------


def _results(spark, folder):
    """Nested result rows from the votes: class 0 counts as benign."""
    voted = voting.hard_vote(adapters.votes(spark, folder))
    malicious = F.col("rfc") != 0
    document = voting.result_document(
        malicious,
        [(v.upper(), F.col(v)) for v in voting.VOTERS],
        F.col("majority"),
        F.col("agreement_ratio"),
        F.col("majority"),
        F.col("low_agreement"),
    )
    return voted.select("row_id", document.alias("result"))


_VOTED_SQL = """SELECT row_id, rfc, xgb, mlp, knn, majority, top_votes, low_agreement FROM votes JOIN
  (SELECT row_id, arg_min(cls, -n * 10 + first_seen) AS majority, max(n) AS top_votes, sum(CASE WHEN n = top THEN 1 ELSE 0 END) > 1 AS low_agreement
   FROM (SELECT *, max(n) OVER (PARTITION BY row_id) AS top FROM (SELECT row_id, cls, count(*) AS n, min(pos) AS first_seen FROM
      (SELECT row_id, rfc AS cls, 1 AS pos FROM votes UNION ALL SELECT row_id, xgb, 2 FROM votes UNION ALL SELECT row_id, mlp, 3 FROM votes
       UNION ALL SELECT row_id, knn, 4 FROM votes) GROUP BY row_id, cls)) GROUP BY row_id) USING (row_id)"""


@query(
    "classifier_list",
    f"""SELECT row_id, CASE WHEN rfc = 0 THEN 'Pre-Detection=Benign@95.0'
          ELSE concat('Pre-Detection=Malicious@90.0;RFC=', CAST(rfc AS VARCHAR), '@85.0;XGB=', CAST(xgb AS VARCHAR), '@87.0;MLP=', CAST(mlp AS VARCHAR), '@89.0;KNN=', CAST(knn AS VARCHAR), '@91.0',
            CASE WHEN low_agreement THEN concat(';LLM Agent=', CAST(majority AS VARCHAR), '@88.0') ELSE '' END) END AS classifiers,
          CASE WHEN rfc = 0 THEN 'Benign' ELSE CAST(majority AS VARCHAR) END AS majority, CASE WHEN rfc = 0 THEN 100.0 ELSE top_votes / 4 * 100.0 END AS agreement_ratio
        FROM ({_VOTED_SQL})""",
    "votes",
)
def classifier_list(spark, folder):
    listed = _results(spark, folder).withColumns(
        {"voters": voting.classifier_list(F.col("result")), "shown": voting.report_majority(F.col("result"))}
    )
    text_of = F.transform(
        "voters", lambda v: F.concat(v["name"], F.lit("="), v["prediction"], F.lit("@"), v["confidence"].cast("string"))
    )
    return listed.select(
        "row_id", F.array_join(text_of, ";").alias("classifiers"), F.col("shown.prediction").alias("majority"), F.col("shown.agreement_ratio").alias("agreement_ratio")
    )


@query(
    "report_rows",
    """SELECT CAST(flow_id AS BIGINT) AS sample_id, dst_ip AS dest_ip, protocol, printf('%.2f', flow_bytes_s) AS flow_bytes_s, src_ip AS source_ip, dst_port AS dest_port,
         printf('%.2f', flow_duration) AS flow_duration, printf('%.2f', flow_packets_s) AS flow_packets_s, src_port AS source_port,
         concat('sample_', CAST(flow_id AS VARCHAR), '.html') AS detail_url, label AS traffic_type, CASE WHEN label = 'Benign' THEN 'green' ELSE 'red' END AS badge FROM flows""",
    "flows",
)
def report_rows(spark, folder):
    """Report rows written as JSON by badge and read back."""
    flows = adapters.flows(spark, folder)
    prediction = F.when(F.col("label") == "Benign", "Benign").otherwise("Malicious")
    path = fresh_path(spark, "report")
    report.write_report(report.report_rows(flows, "flow_id", F.col("label"), prediction), path)
    stored = report.read_report(spark, path)
    return stored.select(
        "sample_id", "dest_ip", "protocol", "flow_bytes_s", "source_ip", "dest_port", "flow_duration", "flow_packets_s",
        "source_port", "detail_url", "traffic_type", "badge",
    )


@query(
    "number_text",
    "SELECT flow_id, printf('%.2f', flow_bytes_s) AS shown FROM flows",
    "flows",
)
def number_text(spark, folder):
    return adapters.flows(spark, folder).select("flow_id", two_decimals(F.col("flow_bytes_s")).alias("shown"))
