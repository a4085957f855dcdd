"""Reports: one nested document for each audit, rendered as JSON or HTML."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCORES = ["overall_score", "technical_score", "onpage_score", "content_score"]
_COUNTS = ["critical_count", "warning_count", "info_count"]


def keyword_list(keywords: DataFrame) -> DataFrame:
    """audit_id, keyword, pages and place of each audit's keywords: most pages first, then by keyword."""
    order = Window.partitionBy("audit_id").orderBy(F.desc("pages"), F.asc("keyword"))
    return keywords.withColumn("place", F.row_number().over(order)).select("audit_id", "keyword", "pages", "place")


def current_rows(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key; a null version is the least, of equal ones the greatest row counts."""
    whole = F.struct(F.col(version).alias("__v"), *[F.col(c) for c in rows.columns])
    newest = rows.groupBy(F.col(key).alias("__k")).agg(F.max(whole).alias("r"))
    return newest.select(*[F.col("r")[c].alias(c) for c in rows.columns])


def next_version(reports: DataFrame) -> DataFrame:
    """audit_id and the version that its next report gets; an audit without versioned reports starts at 1."""
    return reports.groupBy("audit_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The report of the greatest version of each audit."""
    return current_rows(reports, "audit_id", "version")


def assembled(audits: DataFrame, totals: DataFrame, scores: DataFrame, issues: DataFrame, keywords: DataFrame) -> DataFrame:
    """One report row for each audit that has scores: its data, scores, issues in order, pages by score, keywords.

    Lists are built by audit and joined on it; an audit without issues or keywords has empty lists.
    """
    issue = F.struct("place", "rule_id", "category", "severity", "message", "effort_tier", "impact_score", "priority_score", "affected_pages_count", "affected_urls")
    page = F.struct("overall_score", "page_url", *_SCORES[1:], *_COUNTS)
    word = F.struct("place", "keyword", "pages")

    def listed(rows: DataFrame, item: Column, name: str) -> DataFrame:
        return rows.groupBy("audit_id").agg(F.sort_array(F.collect_list(item)).alias(name))

    base = audits.select("audit_id", "tenant_id", "domain", "normalized_url", "status", "submitted_at")
    report = base.join(totals, "audit_id")
    for rows, item, name in ((issues, issue, "issues"), (scores, page, "page_breakdown"), (keywords, word, "keywords")):
        made = listed(rows, item, name)
        report = report.join(made, "audit_id", "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(made.schema[name].dataType)))
    return report.withColumn("has_warnings", F.coalesce(F.col("status") == "completed_with_warnings", F.lit(False)))


def as_json(report: DataFrame) -> DataFrame:
    """audit_id and the report as JSON text."""
    return report.select("audit_id", F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


@F.pandas_udf(T.StringType())
def _page(domain: pd.Series, scores: pd.Series, issues: pd.Series, warned: pd.Series) -> pd.Series:
    def one(name: str | None, values: list[int], rows: list[dict], warn: bool) -> str:
        cells = "".join(f"<li>{escape(label)}: {value}</li>" for label, value in zip(_SCORES, values))
        body = "".join(
            f"<tr><td>{escape(r['rule_id'] or '')}</td><td>{escape(r['severity'] or '')}</td><td>{r['affected_pages_count']}</td>"
            f"<td>{r['priority_score']}</td></tr>"
            for r in rows
        )
        banner = "<p class=warning>Some parts of the analysis are missing.</p>" if warn else ""
        title = escape(name or "")
        return (
            f"<!DOCTYPE html><html><head><meta charset=utf-8><title>Audit of {title}</title></head><body><h1>Audit of {title}</h1>"
            f"{banner}<ul>{cells}</ul><table><tr><th>rule</th><th>severity</th><th>pages</th><th>priority</th></tr>{body}</table></body></html>"
        )

    return pd.Series([one(d, list(s), list(i), bool(w)) for d, s, i, w in zip(domain, scores, issues, warned)])


def as_html(report: DataFrame) -> DataFrame:
    """audit_id and the report as an HTML page; all text is escaped."""
    issues = F.transform("issues", lambda i: F.struct(i["rule_id"].alias("rule_id"), i["severity"].alias("severity"), i["affected_pages_count"].alias("affected_pages_count"), i["priority_score"].alias("priority_score")))
    return report.select("audit_id", _page("domain", F.array(*_SCORES), issues, "has_warnings").alias("html"))
