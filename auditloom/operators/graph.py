"""Rules over the graphs of an audit: equal titles and contents, links, canonicals and language alternates.

Everything is keyed by audit and shuffles keys, never page texts; groups are counted by aggregates with map-side combine
and joined back, so a title shared by a third of all pages is not gathered in one task. All sides grow with the pages and are
joined by sorting: Spark judges them by the compressed size of a written table, of a page's lists too, and would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.functions import urls as ux
from auditloom.functions.ids import stripped
from auditloom.operators.rules import COMPARED_WORDS, FINDING, finding, listed, valid
from auditloom.session import written


def shared_values(pages: DataFrame, key: Column, rule_id: str, name: str | None) -> DataFrame:
    """A finding on each page whose non-empty key occurs on several pages of its audit; evidence: key, the addresses of its
    first pages in order of page_id, and their number."""
    keyed = pages.select("audit_id", "tenant_id", "page_id", F.col("url").alias("page_url"), key.alias("k")).where("k != ''")
    several = listed(keyed, ["audit_id", "k"], "page_url", ["page_id", "page_url"], "duplicate_urls").where("pages > 1")
    evidence = ({name: F.col("k")} if name else {}) | {"duplicate_urls": F.col("duplicate_urls"), "pages": F.col("pages")}
    rows = keyed.hint("merge").join(several, ["audit_id", "k"])
    made = finding(rule_id, evidence, others=F.col("pages") - 1)
    return rows.select("audit_id", "tenant_id", "page_url", F.inline(F.array(made))).select(*FINDING)


def duplicate_titles(pages: DataFrame) -> DataFrame:
    return shared_values(valid(pages), stripped("title"), "onpage.title_duplicate", "title")


def duplicate_descriptions(pages: DataFrame) -> DataFrame:
    return shared_values(valid(pages), stripped("meta_description"), "onpage.meta_description_duplicate", "description")


def duplicate_contents(pages: DataFrame) -> DataFrame:
    key = F.when(F.col("word_count") >= COMPARED_WORDS, tx.sampled_fingerprint(F.col("body_text")))
    # written, as the key is read three times and costs a pass over the text
    keyed = written(valid(pages).select("audit_id", "tenant_id", "page_id", "url", key.alias("fingerprint")), "fingerprints")
    return shared_values(keyed, F.col("fingerprint"), "onpage.duplicate_content", None)


def inbound_links(pages: DataFrame) -> DataFrame:
    """audit_id, address and number of internal links to it, every occurrence, from valid pages."""
    edges = valid(pages).select("audit_id", F.explode(F.filter("links", lambda a: a["is_internal"])).alias("link"))
    return edges.groupBy("audit_id", ux.matching_address(F.col("link.href")).alias("address")).agg(F.count("*").alias("inbound"))


def orphan_pages(pages: DataFrame) -> DataFrame:
    """A finding on each valid page, but a root, that no valid page of the audit links to."""
    rows = valid(pages).where(~ux.path(F.col("url")).isin("", "/")).withColumn("address", ux.matching_address(F.col("url")))
    alone = rows.join(inbound_links(pages).hint("merge"), ["audit_id", "address"], "left_anti")
    made = finding("onpage.orphan_page", {"inbound_links_count": F.lit(0)})
    return alone.select("audit_id", "tenant_id", F.col("url").alias("page_url"), F.inline(F.array(made))).select(*FINDING)


def canonical_chains(pages: DataFrame) -> DataFrame:
    """A finding on each page (status 200) whose canonical target is a page with yet another canonical."""
    points = pages.where("canonical_url != ''").select(
        "audit_id", "page_id", ux.matching_address(F.col("url")).alias("address"), ux.matching_address(F.col("canonical_url")).alias("target")
    )
    # of pages with one address the last one counts
    known = points.groupBy("audit_id", "address").agg(F.max_by("target", "page_id").alias("target"))
    first = (
        pages.where("status_code = 200")
        .select("audit_id", "tenant_id", "url", ux.matching_address(F.col("url")).alias("address"))
        .join(known.hint("merge"), ["audit_id", "address"])
        .where("target != address")
    )
    second = known.select("audit_id", F.col("address").alias("target"), F.col("target").alias("target_2")).where("target_2 != target")
    rows = first.join(second.hint("merge"), ["audit_id", "target"])
    made = finding("technical.canonical_chain_conflict", {"target_1": F.col("target"), "target_2": F.col("target_2")})
    return rows.select("audit_id", "tenant_id", F.col("url").alias("page_url"), F.inline(F.array(made))).select(*FINDING)


def missing_reciprocals(pages: DataFrame) -> DataFrame:
    """A finding on each alternate (of a page with status 200) whose target is such a page of the audit and does not point back."""
    here = ux.matching_address(F.col("url")).alias("address")
    edges = pages.select("audit_id", "tenant_id", "url", "status_code", here, F.explode("hreflangs").alias("h")).where("h.href != ''")
    edges = edges.withColumn("target", ux.matching_address(F.col("h.href")))
    last = pages.groupBy("audit_id", here).agg(F.max_by("status_code", "page_id").alias("status"))
    alive = last.where("status = 200").select("audit_id", F.col("address").alias("target"))
    back = edges.select("audit_id", F.col("address").alias("target"), F.col("target").alias("address")).distinct()
    rows = edges.where("status_code = 200").join(alive.hint("merge"), ["audit_id", "target"], "left_semi").join(back.hint("merge"), ["audit_id", "target", "address"], "left_anti")
    made = finding("technical.hreflang_missing_reciprocal", {"target_page": F.col("h.href"), "hreflang": F.col("h.hreflang")})
    return rows.select("audit_id", "tenant_id", F.col("url").alias("page_url"), F.inline(F.array(made))).select(*FINDING)


#: the analyses across pages, each with a rule of its own
CROSS_PAGE = (duplicate_titles, duplicate_descriptions, duplicate_contents, orphan_pages, canonical_chains, missing_reciprocals)


def cross_page_findings(pages: DataFrame) -> DataFrame:
    whole = CROSS_PAGE[0](pages)
    for part in CROSS_PAGE[1:]:
        whole = whole.unionByName(part(pages))
    return whole
