from pyspark.sql import functions as F

from auditloom.operators import report, scoring
from auditloom.plans import reference

FINDING = "finding_id bigint, audit_id string, tenant_id string, page_url string, category string, rule_id string, severity string, message string, created_at timestamp"


def _findings(spark, *rows):
    return spark.createDataFrame([(k, "A", "t", u, c, r, s, f"m{k}", None) for k, (u, c, r, s) in enumerate(rows)], FINDING)


def test_page_scores(spark):
    f = _findings(spark, *[("u", "technical", "t", "critical")] * 10, ("v", "ONPAGE", "o", "warning"), ("v", None, "o", "warning"), ("v", "keywords", "k", "critical"), ("v", "technical", "t", "warning"), ("v", "content", "c", "Odd"))
    pages = spark.createDataFrame([("A", "w"), ("A", "u")], "audit_id string, page_url string")
    got = {r.page_url: r for r in scoring.page_scores(f, pages).collect()}
    assert (got["u"].technical_score, got["u"].onpage_score, got["u"].overall_score, got["u"].critical_count) == (0, 100, 60, 10)
    assert (got["v"].technical_score, got["v"].onpage_score, got["v"].content_score, got["v"].overall_score) == (95, 90, 84, 91)
    assert got["v"].info_count == 0 and got["w"].overall_score == 100
    total = scoring.audit_scores(scoring.page_scores(f, pages)).first()
    assert (total.technical_score, total.total_pages, total.critical_count) == (65, 3, 11)


def test_weights_are_scaled():
    assert scoring.Weights(technical=2, onpage=1, content=1).shares() == (0.5, 0.25, 0.25)


def test_importance(spark):
    rows = spark.createDataFrame([("https://a.example/", 0), ("https://a.example/x", 0), ("https://a.example/x/y", 0), ("https://a.example/x", 5), ("", 9), ("https://a.example", 100)], "u string, n int")
    assert [r[0] for r in rows.select(scoring.page_importance(F.col("u"), F.col("n"))).collect()] == [2.0, 1.5, 1.2, 1.875, 1.0, 3.0]


def test_rollup(spark):
    f = _findings(spark, ("https://a.example/", "onpage", "onpage.title_missing", "critical"), ("https://a.example/x", "onpage", "onpage.image_alt_missing", "info"), ("https://a.example/", "onpage", "onpage.image_alt_missing", "warning"), ("https://a.example/x/y", "onpage", "onpage.thin_content", "warning"), ("", "onpage", "onpage.thin_content", "info"))
    none = spark.createDataFrame([], "audit_id string, page_url string, inbound bigint")
    got = {r.rule_id: r for r in scoring.issue_places(scoring.issue_rollup(f, none)).collect()}
    assert (got["onpage.title_missing"].impact_score, got["onpage.title_missing"].priority_score, got["onpage.title_missing"].place) == (30.0, 30.0, 1)
    alt = got["onpage.image_alt_missing"]
    assert (alt.severity, alt.message, alt.impact_score, alt.priority_score, alt.affected_pages_count) == ("warning", "m2", 11.5, 5.75, 2)
    assert got["onpage.thin_content"].affected_urls == ["https://a.example/x/y"]
    assert (got["onpage.title_missing"].title, alt.title, alt.tenant_id) == ("Missing Title Tag", "Image Alt Missing", "t")


def test_rule_title(spark):
    rows = spark.createDataFrame([("onpage.some_odd_rule",), ("plain",)], "r string")
    assert [r[0] for r in rows.select(scoring.rule_title(F.col("r"))).collect()] == ["Some Odd Rule", "Plain"]


def test_report(spark):
    f = _findings(spark, ("https://a.example/", "onpage", "onpage.title_missing", "critical"))
    scores = scoring.page_scores(f)
    none = spark.createDataFrame([], "audit_id string, page_url string, inbound bigint")
    issues = scoring.issue_places(scoring.issue_rollup(f, none))
    words = spark.createDataFrame([], "audit_id string, keyword string, pages bigint, place int")
    audits = spark.createDataFrame([("A", "t", "<b>.example", "https://a.example", "completed_with_warnings", None), ("B", "t", "b", "u", None, None)], "audit_id string, tenant_id string, domain string, normalized_url string, status string, submitted_at timestamp")
    made = report.assembled(audits, scoring.audit_scores(scores), scores, issues, words)
    row = made.first()
    assert made.count() == 1 and row.has_warnings and row.keywords == [] and len(row.issues) == 1
    html = report.as_html(made).first().html
    assert "&lt;b&gt;.example" in html and "class=warning" in html and f"overall_score: {row.overall_score}" in html
    assert f'"overall_score" : {row.overall_score}' in report.as_json(made).first().json


def test_versions(spark):
    rows = spark.createDataFrame([("A", 1, "x"), ("A", 3, "y"), ("B", None, "z")], "audit_id string, version int, share_token string")
    assert {tuple(r) for r in report.next_version(rows).collect()} == {("A", 4), ("B", 1)}
    assert {(r.audit_id, r.share_token) for r in report.latest_reports(rows).collect()} == {("A", "y"), ("B", "z")}


def test_queries_score_clean_pages(spark, tmp_path):
    # audit A has a clean page beside one with a finding, audit B no finding at all
    tables = {
        "audit_findings": _findings(spark, ("https://a.example/", "technical", "technical.status_4xx", "critical")),
        "crawl_pages": spark.createDataFrame(
            [(1, "A", "https://a.example/", []), (2, "A", "https://a.example/clean", []), (2, "A", "https://a.example/clean", []), (3, "B", "https://b.example/", [])],
            "page_id bigint, audit_id string, url string, discovered_links array<string>",
        ),
        "page_keywords": spark.createDataFrame([], "audit_id string, page_url string, primary_keyword string"),
        "audits": spark.createDataFrame([(a, "t", a, a, "completed", None, None) for a in "AB"], "audit_id string, tenant_id string, domain string, normalized_url string, status string, submitted_at timestamp, updated_at timestamp"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    at = str(tmp_path)
    assert {(r.page_url, r.overall_score) for r in reference.page_scores(spark, at).collect()} == {("https://a.example/", 94), ("https://a.example/clean", 100), ("https://b.example/", 100)}
    assert {(r.audit_id, r.technical_score, r.total_pages) for r in reference.audit_scores(spark, at).collect()} == {("A", 93, 2), ("B", 100, 1)}
    assert {(r.audit_id, r.issues, r.pages) for r in reference.report_contents(spark, at).collect()} == {("A", 1, 2), ("B", 0, 1)}
    assert {r.audit_id for r in reference.report_documents(spark, at).collect()} == {"A", "B"}
