"""Facts of a page's HTML as one nested row: a single Arrow pass, columns in and columns out."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.markup import CLOSES_P, ESCAPABLE_RAW_TEXT, IMPLIED_END, RAW_TEXT, TAG, VOID, attributes, raw_end

#: Elements whose text is no body text.
OUTSIDE_BODY = frozenset("nav footer header aside script style noscript svg form iframe".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SLICE = 256

FACTS_DDL = (
    "title string, meta_description string, meta_robots string, canonical_url string, viewport string, charset string, "
    "declared_lang string, hreflangs array<struct<hreflang:string,href:string>>, open_graph map<string,string>, "
    "twitter_card map<string,string>, headings array<struct<level:int,text:string>>, "
    "links array<struct<href:string,text:string,is_internal:boolean,is_nofollow:boolean,is_sponsored:boolean,is_ugc:boolean>>, "
    "images array<struct<src:string,alt:string,has_alt:boolean,width:string,height:string,loading:string>>, "
    "structured_data array<string>, body_text string, word_count int, char_count int"
)
_S, _B = pa.string(), pa.bool_()
_FACTS = pa.struct(
    [
        *[(n, _S) for n in "title meta_description meta_robots canonical_url viewport charset declared_lang".split()],
        ("hreflangs", pa.list_(pa.struct([("hreflang", _S), ("href", _S)]))),
        ("open_graph", pa.map_(_S, _S)),
        ("twitter_card", pa.map_(_S, _S)),
        ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", _S)]))),
        ("links", pa.list_(pa.struct([("href", _S), ("text", _S), *[(f"is_{n}", _B) for n in "internal nofollow sponsored ugc".split()]]))),
        ("images", pa.list_(pa.struct([("src", _S), ("alt", _S), ("has_alt", _B), ("width", _S), ("height", _S), ("loading", _S)]))),
        ("structured_data", pa.list_(_S)),
        ("body_text", _S),
        ("word_count", pa.int32()),
        ("char_count", pa.int32()),
    ]
)


def collapse(text: str) -> str:
    return " ".join(text.split())


def count_words(text: str) -> int:
    """Maximal runs of letters and decimal digits."""
    count, inside = 0, False
    for c in text:
        here = c.isalpha() or c.isdecimal()
        count += here and not inside
        inside = here
    return count


def resolve(base: str, reference: str) -> str | None:
    try:
        return urljoin(base, reference)
    except ValueError:
        return None


def host_of(url: str) -> str:
    """Lower-case host without user and port; empty where there is none."""
    try:
        return urlsplit(url).netloc.rpartition("@")[2].lower().partition(":")[0]
    except ValueError:
        return ""


class _Facts:
    """State of the walk over one page."""

    def __init__(self, url: str):
        self.url, self.host = url, host_of(url)
        self.one = dict.fromkeys("title meta_description meta_robots canonical_url viewport charset declared_lang".split(), "")
        self.hreflangs: list[dict] = []
        self.open_graph: dict[str, str] = {}
        self.twitter_card: dict[str, str] = {}
        self.headings: list[dict] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.structured_data: list[str] = []
        self.body: list[str] = []

    def first(self, name: str, value: str) -> None:
        if not self.one[name]:
            self.one[name] = value

    def meta(self, a: dict[str, str]) -> None:
        name, prop, content = a.get("name", "").strip().lower(), a.get("property", "").strip().lower(), a.get("content", "").strip()
        self.first("charset", a.get("charset", "").strip())
        at = content.lower().find("charset=")
        if a.get("http-equiv", "").strip().lower() == "content-type" and at >= 0:
            self.first("charset", content[at + 8 :].strip())
        if "description" in (name, prop):
            self.first("meta_description", content)
        if name in ("robots", "googlebot"):
            self.first("meta_robots", content)
        if name == "viewport":
            self.first("viewport", content)
        if prop.startswith("og:") or name.startswith("og:"):
            self.open_graph[prop or name] = content
        if name.startswith("twitter:") or prop.startswith("twitter:"):
            self.twitter_card[name or prop] = content

    def link(self, a: dict[str, str]) -> None:
        rel, href, lang = a.get("rel", "").strip().lower(), a.get("href", "").strip(), a.get("hreflang", "").strip().lower()
        target = resolve(self.url, href) if href else None
        if target is None:
            return
        if rel == "canonical":
            self.first("canonical_url", target)
        if "alternate" in rel and lang:
            self.hreflangs.append({"hreflang": lang, "href": target})

    def anchor(self, a: dict[str, str]) -> dict | None:
        href = a.get("href", "").strip()
        if not href or href.startswith(("javascript:", "mailto:", "tel:")):
            return None
        target = resolve(self.url, href)
        if target is None or target.partition(":")[0].lower() not in ("http", "https"):
            return None
        rel = a.get("rel", "").lower()
        flags = {f"is_{n}": n in rel for n in ("nofollow", "sponsored", "ugc")}
        made = {"href": target, "text": "", "is_internal": host_of(target) == self.host, **flags}
        self.links.append(made)
        return made

    def image(self, a: dict[str, str]) -> None:
        src = a.get("src", "").strip()
        if src:
            rest = {n: a.get(n, "").strip() for n in ("alt", "width", "height", "loading")}
            self.images.append({"src": resolve(self.url, src) or src, "has_alt": "alt" in a, **rest})

    def row(self) -> dict:
        body = collapse(" ".join(self.body))
        return {
            **self.one,
            "hreflangs": self.hreflangs,
            "open_graph": list(self.open_graph.items()),
            "twitter_card": list(self.twitter_card.items()),
            "headings": self.headings,
            "links": self.links,
            "images": self.images,
            "structured_data": self.structured_data,
            "body_text": body,
            "word_count": count_words(body),
            "char_count": len(body.encode()),
        }


def page_facts(url: str, html: str) -> dict:
    """All facts of one page. Any text is accepted; what is not there is an empty string or list."""
    facts = _Facts(url)
    stack: list[str] = []
    outside = 0
    #: open headings and anchors: their entry and the pieces of their text
    open_: list[tuple[str, dict, list[str]]] = []
    at = 0

    def close(depth: int) -> None:
        nonlocal outside
        for name in reversed(stack[depth:]):
            outside -= name in OUTSIDE_BODY
            if name in _HEADINGS or name == "a":
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == name:
                        _, entry, pieces = open_.pop(k)
                        entry["text"] = collapse("".join(pieces))
                        break
        del stack[depth:]

    def text(piece: str) -> None:
        piece = unescape(piece)
        for _, _, pieces in open_:
            pieces.append(piece)
        if not outside and (kept := piece.strip()):
            facts.body.append(kept)

    while at < len(html):
        hit = TAG.search(html, at)
        if hit is None:
            text(html[at:])
            break
        if hit.start() > at:
            text(html[at : hit.start()])
        at = hit.end()
        slash, name, source = hit.groups()
        if name is None:
            continue
        name = name.lower()
        if slash:
            if name in stack:
                close(len(stack) - 1 - stack[::-1].index(name))
            continue
        if name in CLOSES_P and stack and stack[-1] == "p":
            close(len(stack) - 1)
        if name in IMPLIED_END:
            ends, bounds = IMPLIED_END[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in ends:
                    close(k)
                    break
                if stack[k] in bounds:
                    break
        if name == "a" and "a" in stack:
            close(len(stack) - 1 - stack[::-1].index("a"))
        a = attributes(source)
        if name in RAW_TEXT or name in ESCAPABLE_RAW_TEXT:
            end, after = raw_end(html, name, at)
            raw = html[at:end]
            at = after
            if name == "title":
                facts.first("title", collapse(unescape(raw)))
                text(raw)
            elif name == "script" and a.get("type", "").strip().lower() == "application/ld+json" and raw.strip():
                facts.structured_data.append(raw.strip())
            elif name == "textarea":
                text(raw)
            continue
        if name == "html" and "lang" in a:
            facts.one["declared_lang"] = a["lang"].strip()
        elif name == "meta":
            facts.meta(a)
        elif name == "link":
            facts.link(a)
        elif name == "img":
            facts.image(a)
        if name in VOID or source.endswith("/"):
            continue
        stack.append(name)
        outside += name in OUTSIDE_BODY
        if name in _HEADINGS:
            entry = {"level": int(name[1]), "text": ""}
            facts.headings.append(entry)
            open_.append((name, entry, []))
        elif name == "a" and (link := facts.anchor(a)) is not None:
            open_.append((name, link, []))
        elif name == "a":
            open_.append((name, {}, []))
    close(0)
    return facts.row()


def internal_links(base: str, html: str) -> list[str]:
    """Addresses of the same host that a page links to, in order, each once."""
    found: dict[str, None] = {}
    for link in page_facts(base, html)["links"]:
        target = link["href"]
        if link["is_internal"] and not target.startswith(base + "#"):
            found.setdefault(frontier_address(target))
    return list(found)


def frontier_address(url: str) -> str:
    """The same key as `functions.urls.crawl_address`, for code that runs inside a source."""
    parts = urlsplit(url)
    kind, place = parts.scheme.lower(), parts.netloc.rpartition("@")[2].lower()
    place = place.removesuffix({"http": ":80", "https": ":443"}.get(kind, "\0"))
    return f"{kind}://{place}{parts.path.removesuffix('/')}" + (f"?{parts.query}" if parts.query else "")


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Crawl rows with the facts of their HTML, `parse_status` and `error_message`; no row is lost.

    A page without stored HTML has parse_status `failed`, empty facts and a message with its status code. Needs page_id,
    audit_id, tenant_id, url, status_code, html, error_message; copies of a row stay.
    """
    keep = ["page_id", "audit_id", "tenant_id", "url", "status_code"]
    empty = page_facts("", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                urls, texts = batch.column(3).to_pylist(), batch.column(len(keep)).to_pylist()
                rows = [page_facts(u or "", h) if h else empty for u, h in zip(urls, texts)]
                facts = pa.array(rows, _FACTS)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(keep)], *facts.flatten(), *batch.columns[len(keep) + 1 :]],
                    [*keep, *[f.name for f in _FACTS], "parse_status", "error_message"],
                )

    stored: Column = F.coalesce(F.col("html"), F.lit("")) != ""
    message = F.when(stored, F.coalesce("error_message", F.lit(""))).otherwise(
        F.concat(F.lit("no snapshot available (HTTP "), F.coalesce(F.col("status_code").cast("string"), F.lit("0")), F.lit(")"))
    )
    rows = pages.select(*keep, "html", F.when(stored, "success").otherwise("failed").alias("parse_status"), message.alias("error_message"))
    ddl = f"page_id bigint, audit_id string, tenant_id string, url string, status_code int, {FACTS_DDL}, parse_status string, error_message string"
    return rows.mapInArrow(run, ddl)
