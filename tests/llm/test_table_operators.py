"""Operators over whole tables against brute force, and the pipeline stage by stage."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import make
from pyspark.sql import functions as F

import corpus_pipeline
from flowtide.llm import html_consensus, kd_sharding, minhash, temperature_mixing
from flowtide.llm.components import components
from flowtide.llm.sketches import fingerprint, one_permutation, shingle_set


def brute_components(rows, words=2, percent=80):
    """Smallest doc_id reachable over links of whole shingle sets."""
    sets = {}
    for doc_id, text in rows:
        ws = (text or "").encode().lower().split()
        size = min(words, len(ws))
        sets[doc_id] = {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if ws else set()
    ids = sorted(sets)
    label = {i: i for i in ids}
    by_token = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            by_token[s].add(i)
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in ids:
        shared = Counter(j for s in sets[i] for j in by_token[s] if j > i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_on_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    expected = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == expected
    assert any(c != i for i, (_, c) in expected.items())


def test_near_duplicates_edges(edge, edge_rows, nothing):
    rows = minhash.near_duplicates(edge).collect()
    assert len(rows) == len(edge_rows)
    expected = brute_components([(i, t) for i, t, *_ in edge_rows if i is not None])
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] == 1 and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(nothing).collect() == []


def test_chain_through_a_hub(spark):
    """Copies that are near the original but not each other make one group, whoever is the centre."""
    base = [f"w{i}" for i in range(200)]
    rows = [(100, " ".join(base), "en", "s")]
    for k in range(30):
        edited = list(base)
        for i in range(k * 5, k * 5 + 9, 1):
            edited[i % 200] = f"x{k}_{i}"
        rows.append((k, " ".join(edited), "en", "s"))
    got = {r["component_id"] for r in minhash.near_duplicates(make(spark, rows)).collect()}
    assert got == {0}


def test_many_groups_in_the_same_buckets(spark):
    """Pairs that share only words of one base text, in buckets they share with all others: they outnumber any few centres."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    rows, whole = [], np.ones((500, 299), np.float32)
    for k in range(250):
        places = rng.choice(300, 12, replace=False)
        for doc in (2 * k, 2 * k + 1):
            edited = list(base)
            for i in places:
                edited[i] = f"x{doc}_{i}"
                whole[doc, max(i - 1, 0) : i + 1] = 0
            rows.append((doc, " ".join(edited), "en", "s"))
    both = whole @ whole.T
    root = list(range(500))
    for a, b in np.argwhere(both >= 0.8 * (2 * 299 - both)).tolist():
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(spark, rows)).collect()}
    assert got == dict(enumerate(root))
    assert 100 < len(set(root)) <= 250


def test_deduplicated_keeps_one_of_each_group(edge, edge_rows):
    kept = minhash.deduplicated(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, *_ in edge_rows if i is not None} - {2, 3})


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = np.unique(pool[:1200]), np.unique(pool[300:])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (one_permutation(a, 512) == one_permutation(b, 512)).mean()
    assert abs(same - true) < 0.08
    assert len(shingle_set("A b  C", 2)) == 2 and fingerprint(shingle_set("a B c", 2)) == fingerprint(shingle_set("A b\nc", 2))
    assert len(shingle_set("one", 2)) == 1 and len(shingle_set(None, 2)) == 0
    assert (one_permutation(a[:1], 512) == a[0]).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(60, 99)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 60 for i in [*range(61, 99), 100]} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def check_shards(rows, texts, shards=8):
    sizes = Counter()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes"
        assert r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    return sizes


def test_shards_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = kd_sharding.shard_documents(docs).collect()
    sizes = check_shards(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    biggest = max(r["size"] for r in rows)
    assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.values()) <= biggest


def test_shards_edges(spark, edge, edge_rows, nothing):
    rows = kd_sharding.shard_documents(edge).collect()
    assert len(rows) == len(edge_rows)
    check_shards(rows, {i: t for i, t, *_ in edge_rows})
    assert kd_sharding.shard_documents(nothing).collect() == []


def test_one_source_and_text_is_cut(spark):
    rows = kd_sharding.shard_documents(make(spark, [(1, "same text", "en", "s")] * 400)).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 8


def test_leaves_follow_target_bytes(spark, small):
    points = kd_sharding.prepare(spark.read.parquet(f"{small}/documents.parquet"), ["doc_id"])
    total = points.select(F.sum("kd.size")).first()[0]
    sizes = [r["b"] for r in kd_sharding.shard(points, target_bytes=total // 5).groupBy("shard").agg(F.sum("kd.size").alias("b")).collect()]
    assert len(sizes) == 6 and max(sizes) < 1.5 * total / 6


def test_mixture_budgets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    by_source = Counter()
    for r in docs.collect():
        by_source[r["source"]] += tokens[r["doc_id"]]
    used = temperature_mixing.mixture(docs, max_repeats=2.0).collect()
    assert all(r["tokens"] == tokens[r["doc_id"]] for r in used)
    spent, copies = Counter(), Counter()
    for r in used:
        spent[r["source"]] += r["tokens"]
        copies[r["doc_id"]] += 1
    most, least = max(by_source.values()), min(by_source.values())
    alpha = max(0.0, 1 - math.log(2.0) / math.log(most / least))
    assert set(copies) == set(tokens) and max(copies.values()) <= 2
    for source, total in by_source.items():
        budget = total * (total / most) ** (alpha - 1)
        assert budget - max(tokens.values()) - 1 <= spent[source] <= budget + 1
    epochs = defaultdict(set)
    for r in used:
        epochs[r["doc_id"], r["epoch"]].add(r["block"])
    assert all(len(b) == 1 for b in epochs.values())


def test_entropy_target(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    alpha = temperature_mixing.exponent(totals, entropy_share=0.9)
    weights = np.array([900.0, 90.0, 10.0]) ** alpha
    weights /= weights.sum()
    assert abs(-(weights * np.log(weights)).sum() / math.log(3) - 0.9) < 1e-6
    assert abs(temperature_mixing.exponent(totals, max_repeats=3.0) - (1 - math.log(3) / math.log(90))) < 1e-6
    assert temperature_mixing.exponent(totals, max_repeats=1.0) == 1.0
    assert temperature_mixing.exponent(totals, max_repeats=100.0) == 0.0


def test_blocks_are_taken_in_order(spark, monkeypatch):
    monkeypatch.setattr(temperature_mixing, "BLOCK_TOKENS", 50)
    rows = [(i, "w " * (1 + i % 7), "en", "big") for i in range(300)] + [(1000 + i, "w " * 3, "en", "small") for i in range(40)]
    used = temperature_mixing.mixture(make(spark, rows), budget=900, max_repeats=2.0).collect()
    blocks = defaultdict(set)
    for r in used:
        if r["source"] == "big":
            blocks[r["block"]].add(r["doc_id"])
    assert 1 < len(blocks) < 25
    assert 900 - 60 <= sum(r["tokens"] for r in used) <= 900


def test_mixture_edges(edge, edge_rows, nothing):
    used = temperature_mixing.mixture(edge, max_repeats=4.0).collect()
    assert {r["doc_id"] for r in used} == {i for i, *_ in edge_rows}
    assert sum(r["doc_id"] == 2 for r in used) >= 2
    assert temperature_mixing.mixture(nothing).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head>
<body class="home with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="breadcrumb"><a href=x>Home</a></div><main><article class="post post-12"><header><h1>Title &amp; more</h1><p>By A</p></header>
<p>First <b>para<br>with &lt;tags&gt; &eacute;&#233; and <a href=u>a link</a>.<p>Second &nbsp; one</p><div class="ad-slot">Buy</div>
<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><form>Mail <input name=q><button>Go</button></form>
<section class="related-posts"><p>Other</p></section></article><section id="comments"><article class="comment"><p>Reader's long comment, much
longer than the text itself, so long that it would win by its length alone if it were counted as text of the article.</p></article></section></main>
<aside>side</aside><div role="alert">We use cookies</div><footer>foot</footer>"""


def test_extraction():
    text, path = html_consensus.extract(PAGE, [])
    assert text == "Title & more\nFirst para with <tags> éé and a link.\nSecond one\none\ntwo\nc1\nc2"
    assert path.endswith(">main>article.post.post-")
    assert html_consensus.extract("", []) == ("", "")
    assert html_consensus.extract("plain & simple", [])[0] == "plain & simple"
    assert html_consensus.extract("<p>a<!-- <p>b --><script>c", [])[0] == "a"
    assert html_consensus.extract('<p title="x>y">a</p', [])[0] == "a"
    assert html_consensus.extract("<p>a</p>" + "<b '" * 3000, [])[0].startswith("a")


def test_long_attributes():
    state = '{"a>b": "<p>", "hidden": 1}' * 2000
    page = f"<article><p>one</p><div class='comments' data-state='{state}'><p>reader</p></div><p>two</p><script data-x='{state}'>var x</script></article>"
    assert html_consensus.extract(page, [])[0] == "one\ntwo"
    assert html_consensus.extract(f"<article data-state='{state}'><p>one</p></article>", [])[0] == "one"
    html_consensus.extract("<b '\"' \"" * 100_000 + "<b \"'<b '\"" * 100_000, [])


def test_host_paths_win(spark):
    body = "<html><body><div class='story s{i}'><p>{text}</p></div><div class='extra'><p>{extra}</p></div></body></html>"
    pages = [(i, f"http://h.example/{i}", body.format(i=i, text="main text " * 30, extra="short")) for i in range(30)]
    pages.append((99, "http://h.example/99", body.format(i=99, text="main text " * 20, extra="odd words " * 40)))
    pages += [(200, "no host", "<p>own</p>"), (201, None, None), (202, "http://h.example/e", ""), (99, "http://h.example/99", pages[-1][2])]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, text string")
    rows = html_consensus.extracted_pages(df).collect()
    found = defaultdict(list)
    for r in rows:
        found[r["page_id"]].append(r)
    assert len(rows) == len(pages) and len(found[99]) == 2
    assert found[99][0]["text"] == ("main text " * 20).strip()
    assert found[200][0]["text"] == "own" and found[201][0]["text"] == "" and found[202][0]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_consensus.extracted_pages(df.limit(0)).collect() == []


def test_pages_of_the_table(spark, small):
    import html
    import re

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_consensus.extracted_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        lines = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\n", inner))).split("\n")
        assert got[r["page_id"]] == "\n".join(" ".join(html.unescape(x).split()) for x in lines if x.split())


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        out[name] = docs.toPandas()
        docs = spark.createDataFrame(docs.drop("shard").collect(), docs.drop("shard").schema)
    return out


def test_pipeline_stages(spark, small, stages):
    source = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    columns = list(source.columns)
    first = stages["language"]
    assert all(any(c.isalpha() for c in t) for t in first["text"]) and len(first) == sum(any(c.isalpha() for c in t or "") for t in source["text"])
    groups = brute_components(list(zip(first["doc_id"], first["text"])), words=5)
    second = stages["near_duplicates"]
    assert sorted(second["doc_id"]) == sorted(i for i, (_, c) in groups.items() if i == c)
    import re

    pattern = re.compile(rb"[0-9a-z\x80-\xff]+")
    windows = set()
    for (text,) in spark.read.parquet(f"{small}/benchmark.parquet").select("text").collect():
        ws = pattern.findall((text or "").encode().lower())
        windows |= {tuple(ws[i : i + 10]) for i in range(max(1, len(ws) - 9)) if ws}
    def hit(text):
        ws = pattern.findall(text.encode().lower())
        return any(tuple(ws[i : i + n]) in windows for n in range(1, 11) for i in range(len(ws) - n + 1))
    third = stages["decontamination"]
    assert sorted(third["doc_id"]) == sorted(i for i, t in zip(second["doc_id"], second["text"]) if not hit(t))
    fourth = stages["mixing"]
    assert set(fourth["doc_id"]) == set(third["doc_id"]) and len(fourth) > len(third)
    last = stages["sharding"]
    assert sorted(last["doc_id"]) == sorted(fourth["doc_id"]) and set(last["shard"]) == set(range(8))
    for name, rows in stages.items():
        assert list(rows.columns) == columns + ["shard"] * (name == "sharding")


def test_pipeline_with_odd_rows(spark, small, edge, edge_rows, nothing):
    docs = edge
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.columns == edge.columns + ["shard"] * (name == "sharding")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = {r["doc_id"] for r in docs.collect()}
    assert {1, 4, 8} <= kept and not kept & {2, 3, 5, 6, 7, 12}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, small).count() == 0


def test_prefix_filter_keeps_every_link(spark):
    """All pairs of different parts that reach the similarity are candidates, and few others."""
    rng = np.random.default_rng(8)
    base = np.arange(1, 400)
    sets = {}
    for rep in range(300):
        kept = base[rng.random(len(base)) > rng.choice([0.02, 0.06, 0.12, 0.2])]
        sets[rep] = np.unique(np.concatenate((kept, 10_000 + rep * 1000 + np.arange(rng.integers(0, 60))))).astype(np.uint64)
    parts = {rep: int(rng.choice([0, 0, 0, rep])) for rep in sets}
    members = spark.createDataFrame([(r, parts[r], len(s)) for r, s in sets.items()], "rep long, part long, size long")
    table = spark.createDataFrame([(r, bytearray(s.tobytes())) for r, s in sets.items()], "rep long, shingles binary")
    got = {tuple(r) for r in minhash._filtered(minhash._prefixes(members, table, 80), 80).collect()}
    cross = [(a, b) for a in sets for b in sets if a < b and parts[a] != parts[b]]
    links = set()
    for a, b in cross:
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            links.add((a, b))
    assert links <= got <= set(cross) and len(links) > 100
    assert len(got) < len(links) + 0.5 * (len(cross) - len(links))


LONG = "word and more words of the article, " * 12


@pytest.mark.parametrize("html, text", [
    (f"<article><h1>Title</h1><p>lead</p><div class=body><p>{LONG}</p><p>{LONG}</p></div><p>closing</p></article>", f"Title\nlead\n{LONG.strip()}\n{LONG.strip()}\nclosing"),
    (f"<article><p>before</p><blockquote><p>{LONG}</p></blockquote><p>after</p></article>", f"before\n{LONG.strip()}\nafter"),
    ('<article><h2 id="related-work">Related work</h2><p id="search-methods">a</p><h2 id="social-impact">Impact</h2></article>', "Related work\na\nImpact"),
    ('<div class="form-factor"><p>The form factor is small.</p></div>', "The form factor is small."),
    ('<article><p>See</p><ul><li><a href="/p">Python</a></li><li><a href="/s">Spark</a></li></ul></article>', "See\nPython\nSpark"),
    ('<article><p>shown<span hidden> not shown</span> and <span class="ad">buy <b>now</b></span>on</p><p>next</p></article>', "shown and on\nnext"),
    ('<article><p>a<span class="ad">unclosed</p><p>b</p></article>', "a\nb"),
    ('<body><nav><a>x</a></nav><main><p>in main</p></main><article class="card"><p>a card</p></article></body>', "in main"),
    ('<article><p>text</p><div class="comment-list"><p>nice</p></div><div id="cookie-banner"><p>ok?</p></div><p class="ad">buy</p></article>', "text"),
    ('<article><p>text</p><article class="comment"><p>nice</p></article></article>', "text"),
])
def test_no_text_of_the_article_is_lost(html, text):
    assert html_consensus.extract(html, [])[0] == text
    assert html_consensus.extract(html, [">article", ">article>blockquote", ">article>div.body"])[0] == text


def test_a_narrow_host_path_takes_nothing_away():
    page = f"<body><article class=a><p>{LONG * 3}</p><div class=box><p>{LONG}</p></div></article></body>"
    assert html_consensus.extract(page, [">body>article.a>div.box"])[0] == f"{(LONG * 3).strip()}\n{LONG.strip()}"


def test_pages_without_an_article_lose_only_what_repeats(spark):
    def page(i, extra=""):
        return f"<body><div class=x><p>Welcome to my place</p></div><div class=t><h1>Title {i}</h1><p>Lead {i}</p></div><div class=c{i}><p>Text {i} {LONG}</p></div>{extra}<div class=x><p>All rights</p></div></body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)]
    rows += [(100 + i, f"http://h.example/copy{i}", page(0)) for i in range(10)]  # copies of a page repeat nothing
    rows += [(200, "http://other.example/", page(7)), (201, None, page(8))]
    got = {r["page_id"]: r["text"] for r in html_consensus.extracted_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(20):
        assert got[i] == f"Title {i}\nLead {i}\nText {i} {LONG.strip()}"
    assert {got[100 + i] for i in range(10)} == {got[0]}
    assert got[200] == f"Welcome to my place\nTitle 7\nLead 7\nText 7 {LONG.strip()}\nAll rights"


@pytest.mark.parametrize("unit, end", [("<div>", ""), ("<div>", "</section>"), ("<ul><li>", ""), ("<span class=ad>", ""), ("<div class='c1 c2'>", "</div>")])
def test_deep_pages_take_linear_time(unit, end):
    import time

    start = time.process_time()
    text = html_consensus.extract("<article><p>top</p>" + unit * 100_000 + "deep" + end * 100_000 + "</article>", [">article>div"])[0]
    assert text.startswith("top")
    assert time.process_time() - start < 20
