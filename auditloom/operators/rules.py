"""Rule catalogues as data: each rule is a condition over one page row and the values that its finding reports.

Rules about a page are evaluated together in one projection, so a scan with any number of rules stays one stage. Rules
about several pages are windows and joins in `graph`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.functions import urls as ux
from auditloom.functions.ids import stripped

# --- fixed values: severities of the rules, phrases of links that say nothing, and form of a language code ------------------
SEVERITIES = {
    "onpage.title_missing": "critical", "onpage.title_empty": "critical", "onpage.title_too_short": "warning",
    "onpage.title_too_long": "warning", "onpage.title_duplicate": "warning", "onpage.meta_description_missing": "warning",
    "onpage.meta_description_empty": "warning", "onpage.meta_description_too_short": "info",
    "onpage.meta_description_too_long": "warning", "onpage.meta_description_duplicate": "warning",
    "onpage.h1_missing": "critical", "onpage.h1_multiple": "warning", "onpage.heading_skipped_level": "warning",
    "onpage.heading_empty": "info", "onpage.url_slug_keyword_mismatch": "info", "onpage.image_alt_missing": "warning",
    "onpage.image_alt_is_filename": "info", "onpage.orphan_page": "warning", "onpage.generic_anchor_text": "info",
    "onpage.thin_content": "warning", "onpage.readability_difficult": "info", "onpage.duplicate_content": "warning",
    "technical.status_4xx": "critical", "technical.status_5xx": "critical", "technical.page_unreachable": "critical",
    "technical.canonical_missing": "warning", "technical.canonical_external_domain": "info",
    "technical.canonical_chain_conflict": "warning", "technical.canonical_relative": "warning",
    "technical.meta_noindex": "info", "technical.http_unencrypted": "warning", "technical.mixed_content": "critical",
    "technical.viewport_missing": "critical", "technical.viewport_invalid": "warning",
    "technical.hreflang_missing_reciprocal": "warning", "technical.hreflang_invalid_code": "warning",
    "technical.url_too_long": "info", "technical.url_excessive_parameters": "info",
    "technical.url_non_descriptive_id": "info", "keywords.cannibalization": "warning",
}
#: text of a finding, and the evidence that fills it: as it is, quoted (q:) or by its number of items (n:)
MESSAGES = {
    "onpage.title_missing": ("Page is missing a <title> tag",),
    "onpage.title_empty": ("Page <title> tag is empty",),
    "onpage.title_too_short": ("Title tag is too short (%d characters). Optimal length is 30–60 characters.", "length"),
    "onpage.title_too_long": ("Title tag is too long (%d characters) and may be truncated in search results.", "length"),
    "onpage.title_duplicate": ("Title tag is identical to %d other page(s) on the site", "others"),
    "onpage.meta_description_missing": ("Page is missing a meta description tag",),
    "onpage.meta_description_empty": ("Meta description tag is empty",),
    "onpage.meta_description_too_short": ("Meta description is very short (%d characters). Recommended is 70–160 characters.", "length"),
    "onpage.meta_description_too_long": ("Meta description is too long (%d characters) and will likely be truncated.", "length"),
    "onpage.meta_description_duplicate": ("Meta description is identical to %d other page(s) on the site", "others"),
    "onpage.heading_empty": ("H%d heading tag is empty", "heading_level"),
    "onpage.heading_skipped_level": ("Heading hierarchy skipped levels from H%d directly to H%d", "from_level", "to_level"),
    "onpage.h1_missing": ("Page is missing an <h1> heading tag",),
    "onpage.h1_multiple": ("Page has %d <h1> tags. Pages should generally have a single primary <h1>.", "h1_count"),
    "onpage.url_slug_keyword_mismatch": ("Keywords from URL slug are not present in either the Title tag or primary H1 heading.",),
    "onpage.image_alt_missing": ("Image is missing an alt attribute",),
    "onpage.image_alt_is_filename": ("Image alt text simply repeats the file name instead of describing the image",),
    "onpage.generic_anchor_text": ("Internal link uses generic anchor text (%s) instead of descriptive keywords", "q:anchor_text"),
    "onpage.thin_content": ("Page has thin content (%d words). Aim for at least 250+ substantive words.", "word_count"),
    "onpage.readability_difficult": (
        "Content has a very difficult Flesch Reading Ease score (%.1f/100). Consider simplifying sentence structure.", "flesch_score"
    ),
    "onpage.duplicate_content": ("Page body content is near-identical to %d other page(s)", "others"),
    "onpage.orphan_page": ("Page is an orphan page with 0 internal inbound links discovered from other pages on the site",),
    "technical.status_4xx": ("Page returned a client error HTTP status code (%d)", "status_code"),
    "technical.status_5xx": ("Page returned a server error HTTP status code (%d)", "status_code"),
    "technical.page_unreachable": ("Page unreachable: %s", "error"),
    "technical.http_unencrypted": ("Page is served over insecure plaintext HTTP instead of encrypted HTTPS",),
    "technical.mixed_content": ("HTTPS page loads %d insecure HTTP image(s) (Mixed Content)", "n:insecure_resources"),
    "technical.canonical_missing": ('Page is missing a rel="canonical" link tag to specify its preferred indexing URL',),
    "technical.canonical_relative": ("Canonical URL should be an absolute URL, not a relative path",),
    "technical.canonical_external_domain": ("Canonical tag points to an external domain (%s)", "canonical_host"),
    "technical.meta_noindex": ("Page has a meta robots 'noindex' directive instructing search engines not to index it",),
    "technical.viewport_missing": ('Page is missing a <meta name="viewport"> tag required for mobile-responsive rendering',),
    "technical.viewport_invalid": (
        "Viewport meta tag is present but missing standard responsive directives (width=device-width, initial-scale=1)",
    ),
    "technical.hreflang_invalid_code": ("Invalid hreflang language/region code format (%s)", "q:hreflang"),
    "technical.url_too_long": ("URL is overly long (%d characters). Concise URLs are easier for search engines to crawl.", "length"),
    "technical.url_excessive_parameters": (
        "URL contains %d query parameters. Excessive URL parameters create crawl inefficiency.", "params_count"
    ),
    "technical.url_non_descriptive_id": ("URL uses a non-descriptive parameter (?id=...) instead of human-readable keyword slugs",),
    "technical.canonical_chain_conflict": (
        "Canonical chain conflict detected: page points to %s, which canonicals to %s", "target_1", "target_2"
    ),
    "technical.hreflang_missing_reciprocal": ("hreflang tag pointing to %s is missing a reciprocal link back to this page", "target_page"),
}
NO_ANSWER = "Page was unreachable during crawl"
GENERIC_ANCHORS = [
    "click here", "read more", "learn more", "here", "link", "more", "details", "view more", "continue reading", "website",
]
LANGUAGE_CODE = "^[a-z]{2,3}(-[A-Za-z0-9]{2,8})?$"
SHORT_TITLE, LONG_TITLE, SHORT_DESCRIPTION, LONG_DESCRIPTION = 30, 60, 70, 160
THIN_WORDS, READABLE_WORDS, DIFFICULT_EASE, COMPARED_WORDS = 250, 100, 30.0, 50
LONG_URL_BYTES, MOST_PARAMETERS = 100, 3
#: addresses that a finding about several pages lists; an audit's crawl has no more pages, and the number of all is told too
MOST_LISTED = 50
# ------------------------------------------------------------------------------------------------------------------------------

Values = Callable[[Column], dict[str, Column]]
FINDING = ["audit_id", "tenant_id", "page_url", "category", "rule_id", "severity", "message", "evidence"]


@dataclass(frozen=True)
class Rule:
    """A rule over one page. `when` gives one finding; with `each`, every element of that array gives one."""

    rule_id: str
    when: Column | None = None
    evidence: dict[str, Column] | None = None
    each: Column | None = None
    values: Values | None = None


def quoted(text: Column) -> Column:
    """In double quotes; quotes and backslashes inside are escaped."""
    inner = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def _message(rule_id: str, values: dict[str, Column]) -> Column:
    template, *names = MESSAGES[rule_id]
    if not names:
        return F.lit(template)
    shapes: dict[str, Callable[[Column], Column]] = {"q": quoted, "n": F.size, "": lambda c: c}
    made = F.format_string(template, *[shapes[kind](values[name]) for kind, _, name in (("", "", n) if ":" not in n else n.partition(":") for n in names)])
    return F.when(values["error"] != "", made).otherwise(F.lit(NO_ANSWER)) if names == ["error"] else made


def finding(rule_id: str, evidence: dict[str, Column], message: Column | None = None, **told: Column) -> Column:
    """category, rule_id, severity, message and evidence (JSON) of one finding. `told` fills the message only."""
    pairs = F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()])) if evidence else F.lit("{}")
    return F.struct(
        F.lit(rule_id.partition(".")[0]).alias("category"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(SEVERITIES.get(rule_id, "info")).alias("severity"),
        (_message(rule_id, evidence | told) if message is None else message).alias("message"),
        pairs.alias("evidence"),
    )


def listed(rows: DataFrame, keys: Sequence[str], url: str, order: Sequence[str], name: str) -> DataFrame:
    """keys, pages (rows of each key) and an array `name` of its first MOST_LISTED addresses in order.

    The cut is made before the shuffle as well as after it, so a key that a third of all pages share is not gathered. Both
    sides have up to a row for each page, so they are joined by sorting.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.withColumn("__place", place).where(F.col("__place") <= MOST_LISTED)
    lists = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__place", F.col(url).alias("__url")))).alias("__l"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("pages"))
    return counts.hint("merge").join(lists.select(*keys, F.col("__l.__url").alias(name)), list(keys))


def identified(findings: DataFrame, at: Column) -> DataFrame:
    """Findings with a finding_id, which is the same in every run, and created_at. Equal findings of a page are one."""
    return findings.select(F.xxhash64(*FINDING).alias("finding_id"), *FINDING, at.alias("created_at")).dropDuplicates(["finding_id"])


def _found(rule: Rule) -> Column:
    if rule.each is None:
        return F.when(rule.when, F.array(finding(rule.rule_id, rule.evidence or {})))
    return F.transform(rule.each, lambda x: finding(rule.rule_id, rule.values(x)))


def evaluated(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of all rules over every page, in one projection. A condition that is null does not hold."""
    parts = [_found(r) for r in rules]
    found = F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))
    return pages.select("audit_id", "tenant_id", F.col("url").alias("page_url"), F.inline(found)).select(*FINDING)


def valid(pages: DataFrame) -> DataFrame:
    """Pages that on-page rules look at."""
    return pages.where("parse_status = 'success' and status_code = 200")


def _levels() -> Column:
    """Headings with the level before them, in document order."""
    return F.transform(
        "headings",
        lambda h, k: F.struct(
            h["level"].alias("level"), h["text"].alias("text"), F.get(F.col("headings.level"), k - 1).alias("before")
        ),
    )


def onpage_rules() -> list[Rule]:
    title, description = stripped("title"), stripped("meta_description")
    h1 = F.filter("headings", lambda h: h["level"] == 1)
    h1_texts = F.filter(F.transform(h1, lambda h: stripped(h["text"])), lambda t: t != "")
    words = ux.slug_keywords(F.col("url"))
    corpus = F.lower(F.concat(title, F.lit(" "), F.array_join(h1_texts, " ")))
    ease = tx.reading_ease(F.col("body_text"), F.col("word_count"))
    base = lambda i: F.regexp_extract(i["src"], r"([^/]*)/*$", 1)
    alt = lambda i: F.lower(stripped(i["alt"]))
    missing_alt = lambda i: ~i["has_alt"] | (stripped(i["alt"]) == "")
    named = lambda i: alt(i).isin(F.lower(base(i)), F.lower(F.regexp_replace(base(i), r"\.[^.]*$", "")))
    length = lambda c: {"length": F.length(c)}
    blank = lambda c: (F.col(c) != "") & (stripped(c) == "")
    return [
        Rule("onpage.title_missing", F.col("title") == ""),
        Rule("onpage.title_empty", blank("title")),
        Rule("onpage.title_too_short", (title != "") & (F.length(title) < SHORT_TITLE), length(title) | {"title": title}),
        Rule("onpage.title_too_long", F.length(title) > LONG_TITLE, length(title) | {"title": title}),
        Rule("onpage.meta_description_missing", F.col("meta_description") == ""),
        Rule("onpage.meta_description_empty", blank("meta_description")),
        Rule("onpage.meta_description_too_short", (description != "") & (F.length(description) < SHORT_DESCRIPTION), length(description) | {"description": description}),
        Rule("onpage.meta_description_too_long", F.length(description) > LONG_DESCRIPTION, length(description) | {"description": description}),
        Rule("onpage.heading_empty", each=F.filter("headings", lambda h: stripped(h["text"]) == ""), values=lambda h: {"heading_level": h["level"]}),
        Rule("onpage.heading_skipped_level", each=F.filter(_levels(), lambda h: (h["before"] > 0) & (h["level"] > h["before"] + 1)), values=lambda h: {"from_level": h["before"], "to_level": h["level"], "heading": h["text"]}),
        Rule("onpage.h1_missing", F.size(h1) == 0),
        Rule("onpage.h1_multiple", F.size(h1) > 1, {"h1_count": F.size(h1), "h1_headings": h1_texts}),
        Rule("onpage.url_slug_keyword_mismatch", (F.size(words) > 0) & ~F.exists(words, lambda w: F.contains(corpus, w)), {"slug_keywords": words, "title": title, "h1": h1_texts}),
        Rule("onpage.image_alt_missing", each=F.filter("images", missing_alt), values=lambda i: {"src": i["src"]}),
        Rule("onpage.image_alt_is_filename", each=F.filter("images", lambda i: ~missing_alt(i) & named(i)), values=lambda i: {"src": i["src"], "alt": i["alt"]}),
        Rule("onpage.generic_anchor_text", each=F.filter("links", lambda a: a["is_internal"] & F.lower(stripped(a["text"])).isin(GENERIC_ANCHORS)), values=lambda a: {"href": a["href"], "anchor_text": a["text"]}),
        Rule("onpage.thin_content", F.col("word_count") < THIN_WORDS, {"word_count": F.col("word_count")}),
        Rule("onpage.readability_difficult", (F.col("word_count") >= READABLE_WORDS) & (ease < DIFFICULT_EASE), {"flesch_score": ease, "word_count": F.col("word_count")}),
    ]


def technical_rules() -> list[Rule]:
    url, canonical = F.col("url"), F.col("canonical_url")
    code = {"status_code": F.col("status_code")}
    dead = (F.col("status_code") >= 400) | (F.col("status_code") == 0) | (F.col("parse_status") == "failed")
    alive = ~F.coalesce(dead, F.lit(True))
    insecure = F.filter("images", lambda i: F.lower(i["src"]).startswith("http://"))
    absolute = ux.scheme(canonical) != ""
    viewport = F.lower(stripped("viewport"))
    lang = lambda h: stripped(h["hreflang"])
    bad_code = lambda h: (lang(h) != "") & (F.lower(lang(h)) != "x-default") & ~lang(h).rlike(LANGUAGE_CODE)
    rules = [
        Rule("technical.http_unencrypted", ux.scheme(url) == "http", {"url": url}),
        Rule("technical.mixed_content", (ux.scheme(url) == "https") & (F.size(insecure) > 0), {"insecure_resources": F.transform(insecure, lambda i: i["src"])}),
        Rule("technical.canonical_missing", canonical == ""),
        Rule("technical.canonical_relative", (canonical != "") & ~absolute, {"canonical_url": canonical}),
        Rule("technical.canonical_external_domain", absolute & (F.lower(ux.authority(canonical)) != F.lower(ux.authority(url))), {"canonical_url": canonical, "canonical_host": ux.authority(canonical)}),
        Rule("technical.meta_noindex", F.contains(F.lower("meta_robots"), F.lit("noindex")), {"meta_robots": F.col("meta_robots")}),
        Rule("technical.viewport_missing", viewport == ""),
        Rule("technical.viewport_invalid", (viewport != "") & ~F.contains(viewport, F.lit("width=device-width")) & ~F.contains(viewport, F.lit("initial-scale=1")), {"viewport": F.col("viewport")}),
        Rule("technical.hreflang_invalid_code", each=F.filter("hreflangs", bad_code), values=lambda h: {"hreflang": h["hreflang"], "href": h["href"]}),
        Rule("technical.url_too_long", F.octet_length(url) > LONG_URL_BYTES, {"length": F.octet_length(url), "url": url}),
        Rule("technical.url_excessive_parameters", ux.parameter_count(url) > MOST_PARAMETERS, {"params_count": ux.parameter_count(url), "query": ux.query(url)}),
        Rule("technical.url_non_descriptive_id", ux.first_parameter(url, "id") != "", {"url": url}),
    ]
    living = [
        Rule(r.rule_id, None if r.when is None else alive & r.when, r.evidence, None if r.each is None else F.when(alive, r.each), r.values)
        for r in rules
    ]
    client = F.col("status_code").between(400, 499)
    server = F.col("status_code") >= 500
    return [
        Rule("technical.status_4xx", client, code),
        Rule("technical.status_5xx", server, code),
        Rule("technical.page_unreachable", dead & ~client & ~server, {"error": F.col("error_message")}),
        *living,
    ]


def onpage_findings(pages: DataFrame) -> DataFrame:
    """Findings of the on-page rules about single pages; failed and non-200 pages give none."""
    return evaluated(valid(pages), onpage_rules())


def technical_findings(pages: DataFrame) -> DataFrame:
    """Findings of the technical rules about single pages; a dead page gives exactly one."""
    return evaluated(pages, technical_rules())


def severity_counts(findings: DataFrame, keys: Sequence[str] = ("audit_id",)) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "warning", "info")]
    return findings.groupBy(*keys).agg(*counts, F.count("*").alias("total_findings"))
