"""A whole audit: crawled pages to facts, findings of all analyses, scores and issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators import graph, keywords, report, rules, scoring
from auditloom.operators.html_facts import parsed_pages
from auditloom.session import written, written_parts


@dataclass(frozen=True)
class Audit:
    """What an audit gives. All are written tables or small plans over such."""

    pages: DataFrame
    profiles: DataFrame
    findings: DataFrame
    scores: DataFrame
    totals: DataFrame
    issues: DataFrame

    def reports(self, audits: DataFrame) -> DataFrame:
        """One report row for each row of `audits`, which has one for each audit."""
        words = report.keyword_list(keywords.keyword_map(self.profiles))
        return report.assembled(audits, self.totals, self.scores, self.issues, words)


def findings(parsed: DataFrame, at: Column, profiles: DataFrame | None = None) -> DataFrame:
    """Findings about single pages, across pages and about keywords, each once, with finding_id and created_at `at`; a written table.

    The analyses share no rule, so findings that are equal come from one of them.
    """
    single = rules.onpage_findings(parsed).unionByName(rules.technical_findings(parsed))
    # they are read several times
    known = written(keywords.page_profiles(parsed), "audit-profiles") if profiles is None else profiles
    parts = [single, *[part(parsed) for part in graph.CROSS_PAGE], keywords.conflict_findings(known)]
    return written_parts([rules.identified(part, at) for part in parts], "audit-findings")


def inbound_degree(parsed: DataFrame) -> DataFrame:
    """audit_id, page_url and the pages that link to it, from the internal links of all parsed pages."""
    inner = F.filter("links", lambda a: a["is_internal"])
    return scoring.inbound_degree(parsed.select("audit_id", "page_id", F.explode(F.transform(inner, lambda a: a["href"])).alias("href"))).hint("merge")


def run(crawled: DataFrame, at: Column | None = None, weights: scoring.Weights = scoring.Weights()) -> Audit:
    """Audits all crawled pages (html and fetch metadata, one row for each page) of any number of audits in one job.

    Without any page all results are empty. `at` is the time of the findings, null if it is not given.
    """
    pages = written(parsed_pages(crawled), "audit-pages")
    profiles = written(keywords.page_profiles(pages), "audit-profiles")
    found = findings(pages, F.lit(None).cast("timestamp") if at is None else at, profiles)
    scores = written(scoring.page_scores(found, pages.select("audit_id", F.col("url").alias("page_url")), weights), "audit-scores")
    issues = scoring.issue_places(scoring.issue_rollup(found, inbound_degree(pages)))
    return Audit(pages, profiles, found, scores, scoring.audit_scores(scores, weights), issues)
