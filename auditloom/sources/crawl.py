"""Crawling as rounds of DataFrames over a frontier, with any fetcher.

Each round fetches its frontier in tasks that own whole hosts (so one limiter per host is enough), finds links, and keeps
as the next frontier what no earlier round has seen, up to a cap per audit.  Rounds are written to the scratch folder, so a
lost executor costs one round at most.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.html_facts import frontier_address, internal_links
from auditloom.session import written

#: url -> (status code, content type, body); raises OSError if there is no answer
Fetcher = Callable[[str], tuple[int, str, bytes]]


@dataclass(frozen=True)
class Limits:
    pages: int = 50
    rate: float = 2.0  # requests a second and host
    most_rate: float = 5.0
    body_bytes: int = 10 * 1024 * 1024
    agent: str = "auditloom"


@dataclass
class Robots:
    """What a site's robots text allows. Without one everything is allowed."""

    parser: RobotFileParser | None = None
    delay: float = 0.0
    sitemaps: list[str] = field(default_factory=list)

    def allows(self, agent: str, url: str) -> bool:
        return self.parser is None or self.parser.can_fetch(agent, url)

    def pause(self, limits: Limits) -> float:
        """Seconds between two requests: the site's delay, never less than the highest rate allows, else the usual rate."""
        return max(self.delay, 1 / limits.most_rate) if self.delay else 1 / limits.rate


def parse_robots(text: str, agent: str) -> Robots:
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return Robots(parser, float(parser.crawl_delay(agent) or 0), list(parser.site_maps() or []))


def read_robots(fetch: Fetcher, url: str, agent: str) -> Robots:
    parts = urlsplit(url)
    try:
        status, _, body = fetch(f"{parts.scheme}://{parts.netloc}/robots.txt")
    except OSError:
        return Robots()
    if status >= 400 or not body:
        return Robots()
    return parse_robots(body.decode("utf-8", "replace"), agent)


def sitemap_locations(body: bytes) -> tuple[list[str], list[str]]:
    """(further sitemaps, pages) that a sitemap lists; nothing if it is no sitemap. Gzipped ones are unpacked."""
    if body[:2] == b"\x1f\x8b":
        try:
            body = gzip.decompress(body)
        except OSError:
            return [], []
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", body[:4096], re.I):
        return [], []  # declares entities; a sitemap never does
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return [], []
    kind = root.tag.rpartition("}")[2]
    found = [e.text.strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc" and e.text and e.text.strip()]
    return (found, []) if kind == "sitemapindex" else ([], found) if kind == "urlset" else ([], [])


def sitemap_pages(fetch: Fetcher, url: str, listed: list[str]) -> list[str]:
    """Pages of the site that its sitemaps list, each once; sitemaps may list sitemaps, each is read once."""
    parts = urlsplit(url)
    queue = list(listed) or [f"{parts.scheme}://{parts.netloc}/sitemap.xml"]
    seen: set[str] = set()
    pages: dict[str, None] = {}
    while queue:
        here = queue.pop(0)
        if here in seen:
            continue
        seen.add(here)
        try:
            status, _, body = fetch(here)
        except OSError:
            continue
        if status != 200:
            continue
        further, found = sitemap_locations(body)
        queue += further
        for page in found:
            p = urlsplit(page)
            if p.scheme in ("http", "https") and p.netloc.lower() == parts.netloc.lower():
                pages.setdefault(frontier_address(page))
    return list(pages)


# --- fixed values: why a crawl fails ---
DISALLOWED = "crawling disallowed by site robots.txt policy"
NO_ADDRESS = "invalid normalized URL"
NO_PAGE = "zero pages could be fetched successfully from target domain"
# ---------------------------------------
_SEED = "audit_id string, tenant_id string, url string, place bigint, reason string"


def seeded(seeds: DataFrame, fetch: Fetcher, limits: Limits = Limits()) -> DataFrame:
    """The first frontier: the root of every seed (audit_id, tenant_id, url) and the pages that its sitemaps list, with their
    `place` in order of discovery. A root that is no web address or that robots texts forbid gives one row with a `reason`."""

    def found(url: str | None) -> tuple[list[str], str | None]:
        try:
            parts = urlsplit(url or "")
        except ValueError:
            return [], NO_ADDRESS
        if parts.scheme.lower() not in ("http", "https") or not parts.netloc:
            return [], NO_ADDRESS
        robots = read_robots(fetch, url, limits.agent)
        if not robots.allows(limits.agent, url):
            return [], DISALLOWED
        return list(dict.fromkeys([frontier_address(url), *sitemap_pages(fetch, url, robots.sitemaps)])), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("audit_id", pa.string()), ("tenant_id", pa.string()), ("url", pa.string()), ("place", pa.int64()), ("reason", pa.string())])
        for batch in batches:
            for item in batch.to_pylist():
                urls, reason = found(item["url"])
                rows = [item | {"url": u, "place": k, "reason": None} for k, u in enumerate(urls)] or [item | {"place": 0, "reason": reason}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    rows = seeds.select("audit_id", "tenant_id", "url").distinct()
    made = rows.repartition(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)).mapInArrow(run, _SEED)
    return made.groupBy("audit_id", "tenant_id", "url").agg(F.min("place").alias("place"), F.max("reason").alias("reason"))


_ROUND = (
    "audit_id string, tenant_id string, url string, place bigint, status_code int, content_type string, byte_size bigint, html binary, "
    "fetch_duration_ms bigint, error_message string, discovered_links array<string>"
)


def fetch_round(frontier: DataFrame, fetch: Fetcher, limits: Limits = Limits(), wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Pages of the frontier (audit_id, tenant_id, url, place). Addresses that robots texts forbid give no row; no answer gives
    status 0 and the error. Only successful HTML is kept and searched for links."""

    def one(item: dict) -> dict:
        began, url = time.monotonic(), item["url"]
        row: dict = item | {"status_code": 0, "content_type": "", "byte_size": 0}
        row |= {"html": None, "error_message": "", "discovered_links": []}
        try:
            status, kind, body = fetch(url)
            body = body[: limits.body_bytes]
            row |= {"status_code": status, "content_type": kind.partition(";")[0].strip(), "byte_size": len(body)}
            if status == 200 and "html" in kind.lower():
                row |= {"html": body, "discovered_links": internal_links(url, body.decode("utf-8", "replace"))}
        except OSError as e:
            row["error_message"] = str(e) or type(e).__name__
        row["fetch_duration_ms"] = int((time.monotonic() - began) * 1000)
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Robots] = {}
        schema = pa.schema(
            [("audit_id", pa.string()), ("tenant_id", pa.string()), ("url", pa.string()), ("place", pa.int64()), ("status_code", pa.int32()), ("content_type", pa.string()),
             ("byte_size", pa.int64()), ("html", pa.binary()), ("fetch_duration_ms", pa.int64()), ("error_message", pa.string()), ("discovered_links", pa.list_(pa.string()))]
        )
        for batch in batches:
            for item in batch.to_pylist():
                place = "://".join(urlsplit(item["url"])[:2])
                if place not in known:
                    known[place] = read_robots(fetch, item["url"], limits.agent)
                else:
                    wait(known[place].pause(limits))
                if known[place].allows(limits.agent, item["url"]):
                    yield pa.RecordBatch.from_pylist([one(item)], schema)

    rows = frontier.select("audit_id", "tenant_id", "url", "place")
    return rows.repartition(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)).mapInArrow(run, _ROUND)


def next_frontier(pages: DataFrame, visited: DataFrame, limits: Limits) -> DataFrame:
    """Addresses that pages link to and no round has seen, in order of discovery (place of the page, then of the link), so
    many that an audit's visited ones stay within its cap."""
    links = pages.select("audit_id", "tenant_id", F.col("place").alias("parent"), F.posexplode("discovered_links").alias("pos", "url"))
    links = links.groupBy("audit_id", "tenant_id", "url").agg(F.min(F.struct("parent", "pos")).alias("at"))
    same = F.col("audit_id").eqNullSafe(F.col("a"))
    new = links.join(visited.select(F.col("audit_id").alias("a"), F.col("url").alias("u")), same & (F.col("url") == F.col("u")), "left_anti")
    counts = visited.groupBy(F.col("audit_id").alias("a")).agg(F.count("*").alias("seen"))
    order = F.row_number().over(Window.partitionBy("audit_id").orderBy("at", "url"))
    ranked = new.withColumn("order", order).where(F.col("order") <= limits.pages).join(counts, same, "left")
    place = F.col("order") + F.coalesce("seen", F.lit(0)) - 1
    return ranked.select("audit_id", "tenant_id", "url", place.alias("place")).where(F.col("place") < limits.pages)


def crawl(
    seeds: DataFrame, fetch: Fetcher, limits: Limits = Limits(), wait: Callable[[float], None] = time.sleep, start: DataFrame | None = None
) -> DataFrame:
    """All pages that are reached from the seeds (audit_id, tenant_id, url) and their sitemaps, in breadth-first rounds.

    It ends when there is no new address; the cap of pages of each audit bounds the rounds. `start` is `seeded(...)` of the
    seeds where the caller has it already. `place` of a page tells when it was discovered.
    """
    start = written(seeded(seeds, fetch, limits) if start is None else start, "crawl-seeds").where("reason is null")
    order = F.row_number().over(Window.partitionBy("audit_id").orderBy("place", "url"))
    first = start.withColumn("order", order).where(F.col("order") <= limits.pages)
    frontier = written(first.select("audit_id", "tenant_id", "url", (F.col("order") - 1).cast("bigint").alias("place")), "crawl-frontier")
    visited, pages = start.select("audit_id", "tenant_id", "url"), None
    while not frontier.isEmpty():
        fetched = written(fetch_round(frontier, fetch, limits, wait), "crawl-pages")
        pages = fetched if pages is None else pages.unionByName(fetched)
        frontier = written(next_frontier(fetched, visited, limits), "crawl-frontier")
        visited = visited.unionByName(frontier.select("audit_id", "tenant_id", "url"))
    return seeds.sparkSession.createDataFrame([], _ROUND) if pages is None else pages


def crawl_failures(start: DataFrame, pages: DataFrame) -> DataFrame:
    """audit_id, tenant_id and reason of every crawl that failed: its root is no address or forbidden, or no page was fetched.

    `start` is what `seeded` gives, `pages` what `crawl` gives for it.
    """
    refused = start.where("reason is not null").select("audit_id", "tenant_id", "reason")
    fetched = pages.where("status_code = 200").select("audit_id").distinct().withColumnRenamed("audit_id", "a")
    tried = start.where("reason is null").select("audit_id", "tenant_id").distinct()
    none = tried.join(fetched, F.col("audit_id").eqNullSafe(F.col("a")), "left_anti").withColumn("reason", F.lit(NO_PAGE))
    return refused.unionByName(none).distinct()


def crawl_summary(pages: DataFrame) -> DataFrame:
    """Pages, fetched and failed ones, bytes and time of each audit, and whether the crawl failed for want of any page."""
    ok = F.col("status_code") == 200
    return pages.groupBy("audit_id").agg(
        F.count("*").alias("total_pages"),
        F.count_if(ok).alias("total_fetched"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("total_errors"),
        F.sum("byte_size").alias("total_bytes"),
        F.sum("fetch_duration_ms").alias("fetch_ms"),
    ).withColumn("failed", F.col("total_fetched") == 0)


def snapshot_path(audit_id: str, url: str) -> str:
    return f"{audit_id}/{hashlib.md5(url.encode()).hexdigest()}.html.gz"
