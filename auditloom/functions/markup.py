"""Tag scanner shared by everything that reads HTML.

The box carries no HTML5 library, so the scanner is one compiled pattern plus the few tree rules that matter for
text: void elements, raw-text elements, implied end tags and end tags without a start.  It never raises: whatever is
not a tag is text.
"""

from __future__ import annotations

import re
from html import unescape

# --- fixed values of the HTML standard -------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style iframe noembed noframes xmp".split())
ESCAPABLE_RAW_TEXT = frozenset("title textarea".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: start tag -> (open elements that it ends, elements that bound the search)
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
# ---------------------------------------------------------------------------------------------------------------

#: groups: slash, name, attributes.  Comments, doctypes and processing instructions match without groups.
TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>)|[^>]*)>)",
    re.S,
)
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


def attributes(source: str) -> dict[str, str]:
    """Attributes of one start tag; the first of a repeated name counts, as in browsers."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTR.findall(source):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def raw_end(html: str, name: str, start: int) -> tuple[int, int]:
    """Start and end of the end tag of a raw-text element; the end of the document when there is none."""
    hit = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, start)
    return (hit.start(), hit.end()) if hit else (len(html), len(html))
