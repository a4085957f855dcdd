"""One spelling for all addresses of a page."""

from __future__ import annotations

import re

# --- fixed values: parameters that track a visit or a session, default documents and ports -------------------------------
TRACKING = re.compile(
    r"utm_\w+|gclid|gclsrc|dclid|fbclid|msclkid|yclid|twclid|ttclid|igshid|mc_cid|mc_eid|mkt_tok|_ga|_gl|_hsenc|_hsmi|"
    r"s?sid|phpsessid|jsessionid|aspsessionid\w*|cfid|cftoken|session(?:_?id)?",
    re.I,
)
DEFAULT_DOCUMENT = re.compile(r"(?:index|default)\.(?:html?|php|aspx?|jsp)", re.I)
DEFAULT_PORTS = {"http": "80", "https": "443"}
# ---------------------------------------------------------------------------------------------------------------------------
_PARTS = re.compile(r"\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\s*", re.S)
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_PATH_PARAMETER = re.compile(r";(?:" + TRACKING.pattern + r")=[^/;]*", re.I)


def _plain_escapes(text: str) -> str:
    """Escapes of unreserved characters undone, all others in upper case."""
    if "%" not in text:
        return text

    def one(hit: re.Match[str]) -> str:
        char = chr(int(hit.group(1), 16))
        return char if char in _UNRESERVED else hit.group().upper()

    return _ESCAPE.sub(one, text)


def _plain_path(path: str) -> str:
    path = _PATH_PARAMETER.sub("", _plain_escapes(path))
    parts: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if parts:
                parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    if parts and DEFAULT_DOCUMENT.fullmatch(parts[-1]):
        parts.pop()
    return "/" + "/".join(parts)


def page_address(url: str | None) -> str | None:
    """The address without what does not change the page: case of scheme and host, default port, needless escapes, surplus
    slashes, dot segments, a default document, the fragment, the order of parameters, and tracking parameters and suffixes.

    Null stays null; text that is no absolute address comes back stripped, otherwise as it is.
    """
    if url is None:
        return None
    hit = _PARTS.fullmatch(url)
    if hit is None:
        return url.strip()
    scheme, host, path, query = hit.group(1).lower(), hit.group(2).lower(), hit.group(3), hit.group(4)
    host, _, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    host = host.rstrip(".")
    if port and port != DEFAULT_PORTS.get(scheme):
        host = f"{host}:{port}"
    kept = []
    for pair in _plain_escapes(query or "").split("&"):
        name = pair.partition("=")[0]
        if pair and not TRACKING.fullmatch(name):
            kept.append(pair)
    return f"{scheme}://{host}{_plain_path(path)}" + ("?" + "&".join(sorted(kept)) if kept else "")
