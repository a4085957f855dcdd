"""Whole audits from html, messages of findings, and findings on competing keywords."""

import json

from pyspark.sql import functions as F

from auditloom import session
from auditloom.operators import audit, graph, html_facts, keywords, report, rules
from auditloom.session import written

PAGES = "page_id bigint, audit_id string, tenant_id string, url string, status_code int, html string, error_message string"
PROFILES = "page_id bigint, audit_id string, tenant_id string, page_url string, primary_keyword string"


def _page(k, title, body, audit_id="A", status=200):
    return (k, audit_id, "t", f"https://a.example/p{k}", status, f"<html><head><title>{title}</title></head><body><main>{body}</main></body></html>", "")


def test_messages_cover_all_rules():
    assert set(rules.MESSAGES) | {keywords.CONFLICT} == set(rules.SEVERITIES)
    for template, *names in rules.MESSAGES.values():
        assert template.count("%") == len(names)


def test_whole_audit(spark):
    body = "<h1>Copper kettle</h1><p>" + "A copper kettle boils fast. " * 20 + '</p><a href="/p2">read &quot;more&quot;</a><a href="/p1">Here</a>'
    rows = [_page(1, "Copper kettle guide", body), _page(2, "Copper kettle guide", body), _page(3, "", "<p>short</p>"), _page(4, "Gone", "x", status=404), _page(5, "Other", body, audit_id="B")]
    made = audit.run(spark.createDataFrame(rows, PAGES))
    found = [(r.audit_id, r.page_url[-2:], r.rule_id, r.message, json.loads(r.evidence)) for r in made.findings.collect()]
    by = {(a, u, r): (m, e) for a, u, r, m, e in found}
    assert by["A", "p4", "technical.status_4xx"] == ("Page returned a client error HTTP status code (404)", {"status_code": 404})
    assert by["A", "p3", "onpage.title_missing"][0] == "Page is missing a <title> tag"
    assert by["A", "p1", "onpage.title_too_short"][0].startswith("Title tag is too short (19 characters).")
    message, evidence = by["A", "p2", "onpage.title_duplicate"]
    assert message == "Title tag is identical to 1 other page(s) on the site"
    assert evidence == {"title": "Copper kettle guide", "duplicate_urls": ["https://a.example/p1", "https://a.example/p2"], "pages": 2}
    assert by["A", "p1", "onpage.generic_anchor_text"][0] == 'Internal link uses generic anchor text ("Here") instead of descriptive keywords'
    assert ("B", "p5", "onpage.title_duplicate") not in by and by["A", "p1", "keywords.cannibalization"][1]["competing_urls"] == ["https://a.example/p1", "https://a.example/p2"]
    assert ("A", "p4", "onpage.title_too_short") not in by
    ids = [r.finding_id for r in made.findings.collect()]
    assert len(set(ids)) == len(ids) and {r.finding_id for r in audit.run(spark.createDataFrame(rows, PAGES)).findings.collect()} == set(ids)
    totals = {r.audit_id: r for r in made.totals.collect()}
    assert totals["A"].total_pages == 4 and totals["A"].critical_count == sum(a == "A" and rules.SEVERITIES[r] == "critical" for a, _, r, *_ in found)
    issues = [r for r in made.issues.where("audit_id = 'A'").orderBy("place").collect()]
    assert {r.rule_id for r in issues} == {r for a, _, r, *_ in found if a == "A"} and all(r.tenant_id == "t" and r.title for r in issues)
    assert [r.priority_score for r in issues] == sorted((r.priority_score for r in issues), reverse=True)
    audits = spark.createDataFrame([("A", "t", "a.example", "https://a.example", "completed", None), ("C", "t", "c.example", "u", "failed", None)], "audit_id string, tenant_id string, domain string, normalized_url string, status string, submitted_at timestamp")
    (one,) = report.as_json(made.reports(audits)).collect()
    told = json.loads(one.json)
    assert one.audit_id == "A" and len(told["issues"]) == len(issues) and told["keywords"][0]["pages"] >= 1


def test_audit_of_nothing(spark):
    made = audit.run(spark.createDataFrame([], PAGES))
    assert [x.count() for x in (made.findings, made.scores, made.totals, made.issues)] == [0] * 4


def test_lists_of_addresses_are_cut_but_counted(spark):
    rows = spark.createDataFrame([(k, "A", f"u{k:03}") for k in range(120)] + [(900, "B", "v")], "page_id int, a string, u string")
    got = {r.a: r for r in rules.listed(rows, ["a"], "u", ["page_id"], "urls").collect()}
    assert got["A"].pages == 120 and got["A"].urls == [f"u{k:03}" for k in range(rules.MOST_LISTED)] and got["B"].urls == ["v"]


def test_conflicts_match_a_plain_model(spark):
    words = ["tea", "green tea", "green tea pot", "general", "", "pot", 'a "b"', "tea"]
    rows = [(k, "A" if k % 3 else "B", "t", f"u{k}", words[(k * 5) % len(words)]) for k in range(30)] + [(99, "C", "t", "u", None)]
    wanted = set()
    for a in "ABC":
        pages = sorted(r for r in rows if r[1] == a and r[4] not in (None, "", "general"))
        for w in {r[4] for r in pages}:
            same = [r[3] for r in pages if r[4] == w]
            if len(same) > 1:
                wanted.add((a, same[0], w, ",".join(same)))
        seen = set()
        for i, x in enumerate(pages):
            for y in pages[i + 1 :]:
                if x[4] != y[4] and (x[4] in y[4] or y[4] in x[4]) and (x[4], y[4]) not in seen:
                    seen.add((x[4], y[4]))
                    wanted.add((a, x[3], x[4] + " <-> " + y[4], x[3] + "," + y[3]))
    got = set()
    for r in keywords.conflict_findings(spark.createDataFrame(rows, PROFILES)).collect():
        e = json.loads(r.evidence)
        got.add((r.audit_id, r.page_url, e.get("target_keyword") or e["keyword_1"] + " <-> " + e["keyword_2"], ",".join(e["competing_urls"])))
        assert r.rule_id == keywords.CONFLICT and r.severity == "warning" and r.category == "keywords" and "%" not in r.message
    assert got == wanted and len(got) > 8


def test_quoted(spark):
    row = spark.createDataFrame([('a "b" \\ c',)], "x string").select(rules.quoted(F.col("x")).alias("q")).first()
    assert row.q == '"a \\"b\\" \\\\ c"'


def test_profiles_broadcast_no_terms(spark):
    bodies = ["Copper kettle boils fast on the copper stove", "Green tea in a copper kettle", "Green tea pot and green tea cup with tea", "kettle kettle kettle kettle kettle"]
    rows = [_page(k, bodies[k % 4].title(), f"<h1>{bodies[(k + 1) % 4]}</h1><p>{bodies[k % 4]} {bodies[k % 3]}</p>", audit_id="A" if k % 3 else "B") for k in range(24)]
    pages = spark.createDataFrame(rows + [_page(99, "", "<p>the of and to in it</p>")], PAGES)
    parsed = html_facts.parsed_pages(pages)
    whole, split = keywords.page_profiles(parsed), keywords.page_profiles(parsed, local_pages=10)
    # sides grown from texts are larger than what Spark expects of them
    assert "Broadcast" not in whole._jdf.queryExecution().executedPlan().toString()
    columns = ["page_id", "audit_id", "tenant_id", "page_url", "primary_keyword", "secondary_keywords", "top_terms", "named_entities"]
    got = [sorted(str(tuple(r)) for r in x.select(columns).collect()) for x in (whole, split)]
    assert len(got[0]) == 25 and got[0] == got[1]
    one = {r.page_id: r for r in whole.collect()}
    assert one[99].primary_keyword == "general" and one[99].top_terms is None and one[99].secondary_keywords is None
    # three in the title, three in the paragraph
    assert one[3].top_terms[0].term == one[3].primary_keyword and {t.term: t.occurrences for t in one[3].top_terms}["kettle kettle kettle"] == 6


def test_findings_read_written_profiles(spark):
    rows = [_page(k, "Copper kettle guide", f'<p>A copper kettle boils fast</p><a href="/p{k + 1}">next</a>') for k in range(5)]
    parsed = written(html_facts.parsed_pages(spark.createDataFrame(rows, PAGES)), "parsed")
    found = audit.findings(parsed, F.lit(None).cast("timestamp"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ourselves" not in plan  # a stop word: terms would be counted again for every use of the profiles
    assert "Broadcast" not in audit.inbound_degree(parsed).join(parsed.select("audit_id"), "audit_id")._jdf.queryExecution().executedPlan().toString()
    got = {(r.rule_id, r.page_url[-2:]) for r in found.collect()}
    assert {("keywords.cannibalization", "p0"), ("onpage.title_duplicate", "p4"), ("onpage.orphan_page", "p0")} <= got and ("onpage.orphan_page", "p3") not in got


def test_findings_broadcast_nothing(spark):
    body = "<h1>Copper kettle</h1><p>" + "A copper kettle boils fast. " * 20 + '</p><a href="/p1">next</a>'
    rows = [_page(k, "Copper kettle guide", body) for k in range(6)]
    parsed = written(html_facts.parsed_pages(spark.createDataFrame(rows, PAGES)), "parsed")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # every side grows with the pages, and a written table is smaller than its rows in memory
    assert "Broadcast" not in plan(audit.findings(parsed, F.lit(None).cast("timestamp")))
    copies = graph.duplicate_contents(parsed)
    assert "md5" not in plan(copies)  # the fingerprint of a text is computed once, not for every use
    assert sorted(r.page_url[-2:] for r in copies.collect()) == [f"p{k}" for k in range(6)]
    made = audit.run(spark.createDataFrame(rows, PAGES))
    assert "Broadcast" not in plan(made.issues) and "Broadcast" not in plan(made.totals)
    assert made.totals.first().total_pages == 6 and made.issues.count() > 3


def test_no_plan_of_an_audit_has_all_its_joins(spark, monkeypatch):
    """The driver plans a job anew with every stage that ends, so its heap grew most under one plan with all analyses."""
    body = "<h1>Copper kettle</h1><p>" + "A copper kettle boils fast. " * 20 + '</p><a href="/p1">next</a>'
    rows = [_page(k, "Copper kettle guide", body) for k in range(6)]
    plans, write = {}, session.write_scratch

    def watched(df, name, *rest):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *rest)

    monkeypatch.setattr(session, "write_scratch", watched)
    made = audit.run(spark.createDataFrame(rows, PAGES))
    whole = [p for parts in plans.values() for p in parts]
    assert len(plans["audit-findings"]) > 1 and max(p.count("SortMergeJoin") for p in whole) <= 6
    assert not any("Broadcast" in p for p in whole) and not any("ourselves" in p for p in plans["audit-findings"])
    assert "SortMergeJoin" not in made.findings._jdf.queryExecution().executedPlan().toString()
    # nothing is lost or repeated between the parts: each is the same as if it were made alone
    parts = [rules.onpage_findings(made.pages), rules.technical_findings(made.pages), graph.cross_page_findings(made.pages), keywords.conflict_findings(made.profiles)]
    wanted = {tuple(r) for part in parts for r in part.collect()}
    got = [tuple(r) for r in made.findings.select(rules.FINDING).collect()]
    assert len(got) == len(wanted) and set(got) == wanted and len({r[4] for r in got}) > 4
