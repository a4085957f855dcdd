import json

from pyspark.sql import functions as F

from auditloom.operators import graph, keywords, rules
from auditloom.operators.html_facts import FACTS_DDL, frontier_address, internal_links, page_facts, parsed_pages

PAGE = """<!DOCTYPE html><html lang=" en "><head><meta charset="utf-8"><title>Tools &amp; more
 for you</title><meta name="description" content=" All about tools "><meta name=googlebot content="noindex">
<meta name="viewport" content="width=device-width"><link rel="canonical" href="https://a.example/tools">
<link rel="alternate" hreflang="DE" href="/de"><meta property="og:title" content="T"><meta property="og:type" content="x">
<meta property="og:title" content="last"><meta name="twitter:card" content="big"><meta name="twitter:site" content="@x">
<script type="application/ld+json"> {"@type": "Thing"} </script><style>p{}</style></head><body>
<nav><a href="/one">One</a><a href="two">Two</a> junk</nav><header><h1>Head</h1></header>
<main><h1>Main <b>title</b></h1><h2>Second</h2><h4></h4><p>First paragraph.<p>Next one <a href="https://b.example/x" rel="NoFollow sponsored">out</a>
<a href="/three#p" rel=ugc>Three</a><a href="javascript:x()">no</a><img src="/i.png" alt="" width=3><img src=j.png></main>
<aside><h3>Aside</h3></aside><footer>foot</footer></body></html>"""


def test_page_facts():
    f = page_facts("https://a.example/tools/", PAGE)
    assert f["title"] == "Tools & more for you" and f["declared_lang"] == "en" and f["charset"] == "utf-8"
    assert (f["meta_description"], f["meta_robots"], f["canonical_url"]) == ("All about tools", "noindex", "https://a.example/tools")
    assert f["hreflangs"] == [{"hreflang": "de", "href": "https://a.example/de"}]
    assert dict(f["open_graph"]) == {"og:title": "last", "og:type": "x"} and dict(f["twitter_card"]) == {"twitter:card": "big", "twitter:site": "@x"}
    assert [(h["level"], h["text"]) for h in f["headings"]] == [(1, "Head"), (1, "Main title"), (2, "Second"), (4, ""), (3, "Aside")]
    assert [(a["href"], a["text"], a["is_internal"]) for a in f["links"]] == [
        ("https://a.example/one", "One", True), ("https://a.example/tools/two", "Two", True),
        ("https://b.example/x", "out", False), ("https://a.example/three#p", "Three", True),
    ]
    assert f["links"][2]["is_nofollow"] and f["links"][2]["is_sponsored"] and f["links"][3]["is_ugc"]
    assert [(i["src"], i["has_alt"]) for i in f["images"]] == [("https://a.example/i.png", True), ("https://a.example/tools/j.png", False)]
    assert f["structured_data"] == ['{"@type": "Thing"}']
    assert f["body_text"] == "Tools & more for you Main title Second First paragraph. Next one out Three no"
    assert f["word_count"] == 14 and f["char_count"] == len(f["body_text"].encode())


def test_page_facts_never_fail():
    for html in ("", "<", "<a href='", "<p <b>x</q>", "<script>", "<title>never closed", "&#xZZ;<![CDATA[x]]>", "<a href=http://[>x</a>"):
        assert page_facts("not an address", html)["word_count"] >= 0


def test_internal_links():
    html = '<a href="/a">x</a><a href="/a/">x</a><a href="../b">x</a><a href="https://o.example">x</a><a href="https://s.a.example/">x</a><a href="mailto:x@y">x</a><a href="#f">x</a><a href="c?d=1">x</a>'
    assert internal_links("https://a.example/dir/page", html) == ["https://a.example/a", "https://a.example/b", "https://a.example/dir/c?d=1"]
    assert frontier_address("HTTP://u@A.example:80/x/?q#f") == "http://a.example/x?q"


def _pages(spark, *changes):
    base = dict(
        page_id=0, audit_id="A", tenant_id="t", url="", status_code=200, title="x" * 40, meta_description="d" * 100, meta_robots="", canonical_url="",
        viewport="width=device-width", charset="", declared_lang="", hreflangs=[], open_graph={}, twitter_card={}, headings=[(1, "h")], links=[], images=[],
        structured_data=[], body_text="word", word_count=300, char_count=4, parse_status="success", error_message="",
    )
    rows = [tuple((base | {"page_id": k, "body_text": f"k{k}. " * 300} | c).values()) for k, c in enumerate(changes)]
    ddl = f"page_id bigint, audit_id string, tenant_id string, url string, status_code int, {FACTS_DDL}, parse_status string, error_message string"
    return spark.createDataFrame(rows, ddl)


def _found(df):
    return sorted((r.page_url.rpartition("/")[2], r.rule_id.partition(".")[2]) for r in df.collect())


def test_onpage_rules(spark):
    pages = _pages(
        spark,
        {"url": "https://a.example/blue-lamp", "title": "Blue short title", "headings": [(2, "a"), (4, " ")], "images": [("https://a.example/p/lamp.png", "", False, "", "", ""), ("https://a.example/p/lamp.png", "LAMP", True, "", "", "")],
         "links": [("https://a.example/", "Click Here", True, False, False, False), ("https://b.example/", "here", False, False, False, False)], "word_count": 10},
        {"url": "https://a.example/red-shed", "title": "", "meta_description": "", "headings": [(1, "one"), (1, "two")]},
        {"url": "https://a.example/long", "title": "y" * 61, "meta_description": "z" * 161, "headings": [(1, "long")]},
        {"url": "https://a.example/dead", "title": "", "status_code": 404},
    )
    assert _found(rules.onpage_findings(pages)) == sorted(
        [("blue-lamp", r) for r in ("title_too_short", "heading_empty", "heading_skipped_level", "h1_missing", "image_alt_missing", "image_alt_is_filename", "generic_anchor_text", "thin_content")]
        + [("red-shed", r) for r in ("title_missing", "meta_description_missing", "h1_multiple", "url_slug_keyword_mismatch")]
        + [("long", r) for r in ("title_too_long", "meta_description_too_long")]
    )
    skipped = rules.onpage_findings(pages).where("rule_id = 'onpage.heading_skipped_level'").first()
    assert json.loads(skipped.evidence) == {"from_level": 2, "to_level": 4, "heading": " "} and skipped.severity == "warning"


def test_technical_rules(spark):
    pages = _pages(
        spark,
        {"url": "https://a.example/t1", "status_code": 404, "viewport": ""},
        {"url": "https://a.example/t2", "canonical_url": "/rel", "viewport": "", "meta_robots": "NOINDEX", "images": [("HTTP://a.example/x.png", "a", True, "", "", "")], "hreflangs": [("de", "https://a.example/t3"), ("engl", "https://a.example/zz")]},
        {"url": "https://a.example/t3", "canonical_url": "https://a.example/t3"},
        {"url": "https://a.example/t4", "canonical_url": "https://a.example/t5"},
        {"url": "https://a.example/t5", "canonical_url": "https://other.example/"},
        {"url": "http://a.example/" + "x" * 90 + "?id=1&a=1&b=1&c=1&d=1", "canonical_url": "http://a.example/c", "viewport": "wide"},
        {"url": "https://a.example/t7", "parse_status": "failed", "error_message": "no snapshot available (HTTP 200)"},
    )
    got = [(p[:2], r) for p, r in _found(rules.technical_findings(pages))]
    assert got == sorted(
        [("t1", "status_4xx"), ("t7", "page_unreachable"), ("t5", "canonical_external_domain")]
        + [("t2", r) for r in ("canonical_relative", "viewport_missing", "meta_noindex", "mixed_content", "hreflang_invalid_code")]
        + [("xx", r) for r in ("http_unencrypted", "url_too_long", "url_excessive_parameters", "url_non_descriptive_id", "viewport_invalid")]
    )
    assert _found(graph.canonical_chains(pages)) == [("t4", "canonical_chain_conflict")]
    assert _found(graph.missing_reciprocals(pages)) == [("t2", "hreflang_missing_reciprocal")]


def test_cross_page_rules(spark):
    link = lambda u: [(u, "x", True, False, False, False)]
    pages = _pages(
        spark,
        {"url": "https://a.example/", "title": "Root", "links": link("https://A.example/a/#f")},
        {"url": "https://a.example/a", "title": "Same ", "body_text": "w " * 60, "word_count": 60},
        {"url": "https://a.example/b", "title": "Same", "meta_description": "other", "body_text": "W " * 60, "word_count": 60, "links": link("https://a.example/b")},
        {"url": "https://a.example/c", "title": "Same", "status_code": 500, "links": link("https://a.example/d")},
        {"url": "https://a.example/d", "title": "D", "meta_description": ""},
    )
    assert _found(graph.duplicate_titles(pages)) == [("a", "title_duplicate"), ("b", "title_duplicate")]
    assert _found(graph.duplicate_contents(pages)) == [("a", "duplicate_content"), ("b", "duplicate_content")]
    assert _found(graph.orphan_pages(pages)) == [("d", "orphan_page")]  # b links to itself, which counts
    assert _found(graph.duplicate_descriptions(pages)) == [("", "meta_description_duplicate"), ("a", "meta_description_duplicate")]
    assert graph.cross_page_findings(pages.limit(0)).count() == 0


def test_parsed_pages_keep_every_row(spark):
    rows = [(1, "A", "t", "https://a.example/", 200, PAGE, ""), (2, "A", "t", None, 200, "", None), (3, "A", "t", "https://a.example/x", None, None, "timeout")]
    pages = spark.createDataFrame(rows, "page_id bigint, audit_id string, tenant_id string, url string, status_code int, html string, error_message string")
    got = {r.page_id: r for r in parsed_pages(pages).collect()}
    assert [got[k].parse_status for k in (1, 2, 3)] == ["success", "failed", "failed"]
    assert got[1].title == "Tools & more for you" and got[1].open_graph == {"og:title": "last", "og:type": "x"}
    assert got[3].error_message == "no snapshot available (HTTP 0)" and got[2].links == []


def test_keyword_profiles(spark):
    body = "Email marketing automation helps Acme Tools. Email marketing automation saves time."
    pages = _pages(
        spark,
        {"url": "https://a.example/email-marketing", "title": "Email marketing automation", "headings": [(1, "Email marketing automation")], "body_text": body},
        {"url": "https://a.example/email-marketing-2", "title": "Email marketing automation guide", "body_text": body.replace("helps", "lifts")},
        {"url": "https://a.example/garden", "title": "Garden sheds", "body_text": "Garden sheds keep garden tools dry and garden chairs safe."},
        {"url": "https://a.example/tiny", "word_count": 4},
    )
    got = {r.page_url.rpartition("/")[2]: r for r in keywords.page_profiles(pages).collect()}
    assert set(got) == {"email-marketing", "email-marketing-2", "garden"}
    assert got["email-marketing"].primary_keyword.startswith("email marketing") and "garden" in got["garden"].primary_keyword
    assert got["email-marketing"].named_entities == ["Acme Tools"] and len(got["garden"].top_terms) == 10
    conflicts = keywords.exact_conflicts(keywords.page_profiles(pages)).collect()
    assert [(c.keyword, c.pages) for c in conflicts] == [(got["email-marketing"].primary_keyword, 2)]


def test_overlaps_match_brute_force(spark):
    words = [("A", w, "u") for w in ("shed", "garden shed", "blue garden shed", "she", "lamp", "general", "")] + [("B", "shed", "u")]
    got = {tuple(r) for r in keywords.overlapping_keywords(spark.createDataFrame(words, "audit_id string, primary_keyword string, page_url string")).collect()}
    names = [w for a, w, _ in words if a == "A" and w not in ("general", "")]
    assert got == {("A", i, o) for i in names for o in names if i != o and i in o}
