"""Scores of pages and audits, roll-up of findings to issues, and their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import urls as ux

# --- fixed values: weight of a severity in an issue's impact, and what is known about the rules' effort ---------------------
IMPACT = {"critical": 15.0, "warning": 5.0, "info": 1.0}
RANKS = {"critical": 3, "warning": 2, "info": 1}
EFFORT_COSTS = {"low": 1.0, "medium": 2.0, "high": 3.0}
UNKNOWN_EFFORT = "medium"
RULE_EFFORTS = {
    "low": (
        "onpage.title_missing onpage.title_too_short onpage.title_too_long onpage.meta_description_missing "
        "onpage.meta_description_too_short onpage.meta_description_too_long onpage.h1_missing onpage.heading_skipped_level "
        "onpage.image_missing_alt onpage.image_filename_as_alt onpage.generic_anchor_text technical.canonical_missing "
        "technical.canonical_relative technical.viewport_missing technical.viewport_invalid technical.hreflang_invalid_code"
    ).split(),
    "medium": (
        "onpage.title_duplicate onpage.meta_description_duplicate onpage.h1_multiple onpage.flesch_reading_difficult "
        "onpage.orphan_page technical.status_4xx technical.canonical_external technical.mixed_content "
        "technical.hreflang_missing_reciprocal technical.url_too_long technical.excessive_query_params keywords.missing_primary"
    ).split(),
    "high": (
        "onpage.thin_content onpage.duplicate_body technical.status_5xx technical.unreachable technical.canonical_chain "
        "keywords.cannibalization"
    ).split(),
}
RULE_TITLES = {
    "onpage.title_missing": "Missing Title Tag",
    "onpage.title_too_short": "Title Tag Too Short",
    "onpage.title_too_long": "Title Tag Too Long",
    "onpage.title_duplicate": "Duplicate Title Tags",
    "onpage.meta_description_missing": "Missing Meta Description",
    "onpage.meta_description_too_short": "Meta Description Too Short",
    "onpage.meta_description_too_long": "Meta Description Too Long",
    "onpage.meta_description_duplicate": "Duplicate Meta Description",
    "onpage.h1_missing": "Missing H1 Heading",
    "onpage.h1_multiple": "Multiple H1 Headings",
    "onpage.heading_skipped_level": "Skipped Heading Levels",
    "onpage.image_missing_alt": "Missing Image Alt Attributes",
    "onpage.image_filename_as_alt": "Image Filename Used as Alt Text",
    "onpage.thin_content": "Thin Content (<250 words)",
    "onpage.flesch_reading_difficult": "Low Readability Score",
    "onpage.generic_anchor_text": "Generic Link Anchor Text",
    "onpage.orphan_page": "Orphan Page (No Inbound Internal Links)",
    "onpage.duplicate_body": "Duplicate Body Content Across Pages",
    "technical.status_4xx": "Broken Page (4xx Client Error)",
    "technical.status_5xx": "Server Error (5xx Internal Error)",
    "technical.unreachable": "Unreachable Page",
    "technical.canonical_missing": "Missing Canonical Tag",
    "technical.canonical_relative": "Relative Canonical URL",
    "technical.canonical_external": "External Canonical Tag",
    "technical.canonical_chain": "Canonical Chain / Conflict",
    "technical.mixed_content": "Insecure Mixed Content on HTTPS",
    "technical.viewport_missing": "Missing Mobile Viewport Tag",
    "technical.viewport_invalid": "Invalid Mobile Viewport Tag",
    "technical.hreflang_invalid_code": "Invalid Hreflang Language Code",
    "technical.hreflang_missing_reciprocal": "Missing Reciprocal Hreflang Tag",
    "technical.url_too_long": "Excessively Long URL (>200 chars)",
    "technical.excessive_query_params": "Excessive URL Query Parameters (>3)",
    "keywords.cannibalization": "Keyword Cannibalization (Multiple Pages Competing)",
    "keywords.missing_primary": "Missing Primary Keyword Focus",
}
# ------------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """Deductions by severity, and weights of the categories; weights that don't sum to 1 are scaled."""

    critical: float = 15.0
    warning: float = 5.0
    info: float = 1.0
    technical: float = 0.40
    onpage: float = 0.35
    content: float = 0.25

    def shares(self) -> tuple[float, float, float]:
        total = self.technical + self.onpage + self.content
        scale = total if total > 0 and abs(total - 1) > 0.001 else 1.0
        return self.technical / scale, self.onpage / scale, self.content / scale


def _by_severity(severity: Column, values: dict[str, float], other: float) -> Column:
    chosen: Column = F.lit(other)
    for name, value in values.items():
        chosen = F.when(severity == name, F.lit(value)).otherwise(chosen)
    return chosen


def _overall(weights: Weights) -> Column:
    t, o, c = weights.shares()
    mixed = F.lit(t) * F.col("technical_score") + F.lit(o) * F.col("onpage_score") + F.lit(c) * F.col("content_score")
    # ten digits first, so that a half is a half whatever the order of the sum
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.round(mixed, 10)).cast("int")))


def page_scores(findings: DataFrame, pages: DataFrame | None = None, weights: Weights = Weights()) -> DataFrame:
    """audit_id, page_url, the four scores and the severity counts of every page with findings and of every page of `pages`.

    Each finding takes its severity's deduction from its category's 100; `keywords` is content, an unknown or null category
    is on-page, an unknown severity deducts as info and is not counted. `pages` has audit_id and page_url.
    """
    category = F.lower(F.coalesce("category", F.lit("")))
    deduction = _by_severity(F.col("severity"), {"critical": weights.critical, "warning": weights.warning}, weights.info)
    kind = F.when(category == "technical", "technical").when(category.isin("keywords", "content"), "content").otherwise("onpage")
    sums = findings.select("audit_id", "page_url", "severity", deduction.alias("d"), kind.alias("k")).groupBy("audit_id", "page_url").agg(
        *[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("d"))), F.lit(0.0)).alias(f"d_{k}") for k in ("technical", "onpage", "content")],
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in RANKS],
    )
    if pages is not None:
        sums = pages.select("audit_id", "page_url").distinct().join(sums, ["audit_id", "page_url"], "full").na.fill(0)
    scores = [F.greatest(F.lit(0), F.round(F.lit(100.0) - F.col(f"d_{k}")).cast("int")).alias(f"{k}_score") for k in ("technical", "onpage", "content")]
    counts = [f"{s}_count" for s in RANKS]
    return sums.select("audit_id", "page_url", *scores, *counts).withColumn("overall_score", _overall(weights))


def audit_scores(scores: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Mean of the rounded page scores by audit, rounded; the overall score comes from the rounded category scores."""
    means = [F.round(F.avg(f"{k}_score")).cast("int").alias(f"{k}_score") for k in ("technical", "onpage", "content")]
    sums = [F.sum(f"{s}_count").alias(f"{s}_count") for s in RANKS]
    return scores.groupBy("audit_id").agg(*means, *sums, F.count("*").alias("total_pages")).withColumn("overall_score", _overall(weights))


def inbound_degree(edges: DataFrame) -> DataFrame:
    """audit_id, page_url and `inbound`, the pages that link to it, from edges (audit_id, page_id, href)."""
    pairs = edges.where("href is not null and href != ''").select("audit_id", "page_id", "href").distinct()
    return pairs.groupBy("audit_id", F.col("href").alias("page_url")).agg(F.count("*").alias("inbound"))


def page_importance(url: Column, inbound: Column) -> Column:
    """Weight of a page by its depth, raised by up to a half with inbound links, 3 at most; 1 for an empty address."""
    depth = ux.path_depth(url)
    base = F.when(depth == 0, 2.0).when(depth == 1, 1.5).when(depth == 2, 1.2).otherwise(1.0)
    weight = F.least(F.lit(3.0), base * (F.lit(1.0) + F.least(F.lit(0.5), F.lit(0.05) * inbound)))
    return F.when(F.coalesce(url, F.lit("")) == "", 1.0).otherwise(weight)


def _effort(rule: Column) -> Column:
    chosen: Column = F.lit(UNKNOWN_EFFORT)
    for tier, rules in RULE_EFFORTS.items():
        chosen = F.when(rule.isin(rules), F.lit(tier)).otherwise(chosen)
    return chosen


def issue_rollup(findings: DataFrame, inbound: DataFrame) -> DataFrame:
    """Issues of each audit: one row for each rule, with tenant, category, worst severity, title, message, pages, impact and
    priority.

    Findings need finding_id, audit_id, tenant_id, page_url, category, rule_id, severity, message and created_at. Tenant and
    category are the first finding's (by time, then id), the message that of the first finding of the worst severity. Impact is the sum of
    severity weight times page importance, priority is impact by the rule's effort; both have two digits.
    """
    place = F.struct(F.col("created_at").isNull(), "created_at", "finding_id")
    rank = _by_severity(F.col("severity"), RANKS, 0)
    weight = _by_severity(F.col("severity"), IMPACT, IMPACT["info"])
    known = findings.join(inbound, ["audit_id", "page_url"], "left")
    impact = (weight * page_importance(F.col("page_url"), F.coalesce("inbound", F.lit(0)))).cast("decimal(18,6)")
    rows = known.select(
        "audit_id", "tenant_id", "rule_id", "page_url", "category", "severity", "message", place.alias("place"), rank.alias("rank"), impact.alias("impact")
    )
    worst = F.struct(-F.col("rank"), "place")
    grouped = rows.groupBy("audit_id", "rule_id").agg(
        F.min_by(F.struct("tenant_id", "category"), "place").alias("first"),
        F.min_by(F.struct("severity", "message"), worst).alias("top"),
        F.sort_array(F.collect_set(F.when(F.col("page_url") != "", F.col("page_url")))).alias("affected_urls"),
        F.sum("impact").alias("total"),
    )
    effort = _effort(F.col("rule_id"))
    cost = _by_severity(F.col("effort_tier"), EFFORT_COSTS, EFFORT_COSTS[UNKNOWN_EFFORT])
    total = F.col("total").cast("double")
    return grouped.withColumn("effort_tier", effort).select(
        "audit_id", F.col("first.tenant_id").alias("tenant_id"), "rule_id", F.col("first.category").alias("category"),
        F.col("top.severity").alias("severity"), rule_title(F.col("rule_id")).alias("title"), F.col("top.message").alias("message"), "effort_tier",
        F.round(total, 2).alias("impact_score"), F.round(total / cost, 2).alias("priority_score"),
        F.size("affected_urls").alias("affected_pages_count"), "affected_urls",
    )


def issue_places(issues: DataFrame) -> DataFrame:
    """issues with their `place` in the audit: priority, impact descending, then rule."""
    order = Window.partitionBy("audit_id").orderBy(F.desc("priority_score"), F.desc("impact_score"), F.asc("rule_id"))
    return issues.withColumn("place", F.row_number().over(order))


def rule_title(rule: Column) -> Column:
    """Title of a rule; one that has none gets the second part of its id, words capitalised."""
    known = F.create_map(*[F.lit(x) for pair in RULE_TITLES.items() for x in pair])
    name = F.coalesce(F.get(F.split(rule, r"\."), F.lit(1)), rule)
    return F.coalesce(F.try_element_at(known, rule), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor")
