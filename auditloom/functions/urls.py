"""URL columns. All run on the JVM by one splitting pattern (RFC 3986, appendix B); none ever raises.

The spellings of one address differ on purpose by what they are for: `crawl_address` keys the crawl frontier,
`submitted_address` keys an audit, `matching_address` compares links, canonicals and language alternates.
"""

from __future__ import annotations

import ipaddress
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
_SCHEME, _AUTHORITY, _PATH, _QUERY = 1, 2, 3, 4

# --- fixed values: words of a slug that say nothing, and address ranges that must not be fetched ------------------------
SLUG_STOP_WORDS = ["the", "a", "an", "and", "of", "in", "to", "for"]
RESERVED_RANGES = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4",
    "240.0.0.0/4", "255.255.255.255/32", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8",
]
# --------------------------------------------------------------------------------------------------------------------------


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, _SCHEME))


def authority(url: Column) -> Column:
    return _part(url, _AUTHORITY)


def path(url: Column) -> Column:
    return _part(url, _PATH)


def query(url: Column) -> Column:
    """Query without its question mark; empty if there is none."""
    return _part(url, _QUERY)


def _host_port(url: Column) -> Column:
    return F.lower(F.regexp_replace(authority(url), r"^.*@", ""))


def host(url: Column) -> Column:
    """Lower-case host without port."""
    return F.regexp_extract(_host_port(url), r"^([^:]*)", 1)


def _without_default_port(url: Column) -> Column:
    full, kind = _host_port(url), scheme(url)
    return (
        F.when(kind == "http", F.regexp_replace(full, ":80$", ""))
        .when(kind == "https", F.regexp_replace(full, ":443$", ""))
        .otherwise(full)
    )


def _query_mark(url: Column) -> Column:
    return F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit(""))


def crawl_address(url: Column) -> Column:
    """Key of the crawl frontier: no default port, user or fragment, and one closing slash less."""
    return F.concat(scheme(url), F.lit("://"), _without_default_port(url), F.regexp_replace(path(url), "/$", ""), _query_mark(url))


def submitted_error(url: Column) -> Column:
    """Why a submitted address is refused; null if it is accepted. Null and blank addresses count as empty."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    return (
        F.when(raw == "", "URL must not be empty")
        .when((_part(raw, _SCHEME) == "") | (authority(raw) == ""), "URL must be absolute")
        .when(~scheme(raw).isin("http", "https"), "unsupported scheme")
    )


def submitted_address(url: Column) -> Column:
    """Key of an audit: no default port, closing slashes or fragment. Null for refused addresses."""
    raw = F.trim(url)
    made = F.concat(scheme(raw), F.lit("://"), _without_default_port(raw), F.regexp_replace(path(raw), "/+$", ""), _query_mark(raw))
    return F.when(submitted_error(url).isNull(), made)


def matching_address(url: Column) -> Column:
    """Form in which links and targets are compared: lower-case host, no fragment or closing slashes; ports stay."""
    kind, place = scheme(url), authority(url)
    front = F.concat(
        F.when(kind != "", F.concat(kind, F.lit(":"))).otherwise(F.lit("")),
        F.when(place != "", F.concat(F.lit("//"), F.lower(place))).otherwise(F.lit("")),
    )
    return F.concat(front, F.regexp_replace(path(url), "/+$", ""), _query_mark(url))


def _last_segment(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), r"([^/]*)$", 1), r"\.html$", "")


def slug_keywords(url: Column) -> Column:
    """Words of the last path segment, of three bytes or more, without the ones that say nothing; empty for a root."""
    words = F.split(F.lower(_last_segment(url)), "[-_]+")
    kept = F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(SLUG_STOP_WORDS))
    return F.when(path(url).isin("", "/"), F.array().cast("array<string>")).otherwise(kept)


def slug_text(url: Column) -> Column:
    """Last path segment with blanks for hyphens."""
    return F.replace(_last_segment(url), F.lit("-"), F.lit(" "))


def path_depth(url: Column) -> Column:
    """Segments of the path; 0 for a root."""
    inner = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "/")))


def _parameters(url: Column) -> Column:
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def parameter_count(url: Column) -> Column:
    """Distinct names in the query."""
    return F.size(F.array_distinct(F.transform(_parameters(url), lambda p: F.substring_index(p, "=", 1))))


def first_parameter(url: Column, name: str) -> Column:
    """Value of a parameter's first occurrence; empty if it has none, null if it does not occur."""
    mine = F.filter(_parameters(url), lambda p: F.substring_index(p, "=", 1) == name)
    return F.regexp_replace(F.get(mine, F.lit(0)), "^[^=]*=?", "")


@cache
def _ranges() -> list[ipaddress.IPv4Network | ipaddress.IPv6Network]:
    return [ipaddress.ip_network(r) for r in RESERVED_RANGES]


def reserved(address: str) -> bool:
    """Whether an address lies in a range that must not be fetched. What is no address counts as reserved."""
    try:
        ip = ipaddress.ip_address(address.strip())
    except ValueError:
        return True
    mapped = getattr(ip, "ipv4_mapped", None)
    return any((mapped or ip) in r for r in _ranges())


@F.pandas_udf(T.BooleanType())
def is_reserved_ip(address: pd.Series) -> pd.Series:
    """`reserved` as a column. Null stays null."""
    return address.map(lambda text: None if text is None else reserved(text)).astype("object")
