"""Queries of the training-data problems over the whole tables, and their SQL where there is any."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.addresses import page_address
from auditloom.llm.bpe import encode_texts
from auditloom.llm.mixing import mix
from auditloom.llm.near_duplicates import all_pairs, class_links, linked_classes, similarity
from auditloom.llm.pages import BODY_SHINGLE, KEYS, NEAR, Extra, fit_model, main_body_keys, page_bodies
from auditloom.llm.reading_level import fit, reading_levels
from auditloom.llm.residue import residue_pages
from auditloom.llm.top_n import top_n
from auditloom.session import table, written

#: Folder of the public tokenizers' files, the same on every machine.
TOKENIZERS = os.environ.get("AUDITLOOM_TOKENIZERS", "/opt/tokenizers")
#: Similarity from which p4 counts two main bodies as near-duplicates; its statement fixes it.
BODY_SIMILARITY = 0.7


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """First five issues of each audit."""
    issues = table(spark, directory, "prioritized_issues").where("priority_score is not null and not isnan(priority_score)")
    order = [("priority_score", True), ("impact_score", True), ("rule_id", False), ("issue_id", False)]
    return top_n(issues, ["audit_id"], order, 5).select("audit_id", "issue_id")


def _bodies(spark: SparkSession, directory: str, extra: Extra | None) -> DataFrame:
    pages = table(spark, directory, "crawl_pages")
    return written(page_bodies(pages, fit_model(pages), extra), "bodies")


@F.pandas_udf(T.StringType())
def _address(urls: pd.Series) -> pd.Series:
    return urls.map(page_address, na_action="ignore")


def _page_members(spark: SparkSession, directory: str) -> DataFrame:
    """Main bodies of the pages that are no residue, as members of classes of equal ones."""
    bodies = _bodies(spark, directory, NEAR)
    residue = written(residue_pages(bodies), "residue")
    return bodies.join(residue, "page_id", "left_anti").where("near is not null").select(F.col("page_id").alias("id"), "near.*")


def _address_members(spark: SparkSession, directory: str) -> DataFrame:
    """Addresses as members of classes of one spelling in an audit.

    What they are compared by is the audit and the spelling without what does not change the page, so the sketches of one
    page's addresses are equal.
    """
    rows = table(spark, directory, "page_keywords").where("keyword_id is not null and audit_id is not null and page_url is not null")
    named = rows.select(
        F.col("keyword_id").alias("id"), F.unhex(F.md5(F.concat_ws("\n", "audit_id", "page_url"))).alias("class"),
        F.concat_ws("\n", "audit_id", _address("page_url")).alias("body"),
    )
    return named.select("id", "class", F.unhex(F.md5("body")).alias("sketch"), F.array(F.xxhash64("body")).alias("buckets"), "body")


def _linked(members: DataFrame, pages: bool) -> tuple[DataFrame, DataFrame]:
    """Members as a written table, and the links between their classes."""
    members = written(members, "members")
    if pages:
        alike = similarity(BODY_SHINGLE)
        links = class_links(members, lambda a, b: alike(a, b) >= BODY_SIMILARITY)
    else:
        links = class_links(members, lambda a, b: a == b, radius=0)
    return members, written(links, "links")


def _of_both(spark: SparkSession, directory: str, use: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    pages = use(*_linked(_page_members(spark, directory), True))
    addresses = use(*_linked(_address_members(spark, directory), False))
    return pages.select(F.lit("crawl_pages").alias("record_table"), "*").unionByName(
        addresses.select(F.lit("page_keywords").alias("record_table"), "*")
    )


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of near-duplicate pages, and of addresses of one page within an audit."""
    return _of_both(spark, directory, all_pairs).distinct()


def p4_classes(spark: SparkSession, directory: str) -> DataFrame:
    """record_table, id, class_id and number of links of every page with a main body and every address.

    Members of one class are copies; links lead to other classes of near-duplicates.
    """
    return _of_both(spark, directory, linked_classes)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Blocks of the main body of each page that is no residue."""
    bodies = _bodies(spark, directory, KEYS)
    return main_body_keys(bodies, residue_pages(bodies))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pages that hold template residue or an error message instead of content."""
    return residue_pages(_bodies(spark, directory, None))


def p7_ids(spark: SparkSession, directory: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Ids of every document by byte_bpe_50k; empty and null texts have an empty list."""
    return encode_texts(table(spark, directory, "documents"), ["doc_id"], "text", f"{tokenizers}/byte_bpe_50k.json")


def _mix(spark: SparkSession, directory: str, tokenizers: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, directory, "documents")
    ids = encode_texts(documents, ["source"], "text", f"{tokenizers}/byte_bpe_50k.json", "packed")
    return mix(written(ids, "encoded"), table(spark, directory, "source_targets"))


def p8_mix(spark: SparkSession, directory: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The mixed corpus: token blocks of all sources by their target shares."""
    return _mix(spark, directory, tokenizers)[0]


def p8_shares(spark: SparkSession, directory: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Target and actual share of every source of the mix."""
    return _mix(spark, directory, tokenizers)[1]


def p9_levels(spark: SparkSession, directory: str) -> DataFrame:
    """Words of English prose, reading level and what it rests on, of every document."""
    documents = table(spark, directory, "documents")
    return reading_levels(documents, fit(documents, table(spark, directory, "reading_labels")))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents whose English prose is of level 4 or 5."""
    return p9_levels(spark, directory).where("basis = 'prose' and reading_level >= 4").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
}

ORACLES: dict[str, str] = {
    "p1_found": """
        SELECT audit_id, issue_id FROM (
          SELECT audit_id, issue_id, row_number() OVER (
            PARTITION BY audit_id ORDER BY priority_score DESC, impact_score DESC, rule_id, issue_id) AS place
          FROM (SELECT DISTINCT audit_id, issue_id, rule_id, priority_score, impact_score FROM prioritized_issues
                WHERE priority_score IS NOT NULL AND CAST(priority_score AS VARCHAR) <> 'nan'))
        WHERE place <= 5""",
}
