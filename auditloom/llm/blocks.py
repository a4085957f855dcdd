"""Leaf blocks of a page: the units that the main-body model labels."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

from auditloom.functions.markup import CLOSES_P, IMPLIED_END, RAW_TEXT, ESCAPABLE_RAW_TEXT, TAG, VOID, raw_end

#: Elements whose text is a block when no other of them lies inside.
BLOCK_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd div".split())
#: Elements at whose edges a run of text ends.
EDGES = BLOCK_ELEMENTS | frozenset(
    "address amp-sidebar article aside body center caption details dialog dl dt fieldset figcaption figure footer form head "
    "header hgroup hr html main menu nav noscript ol option section select summary table tbody tfoot thead th tr ul".split()
)
CODE = frozenset("code kbd samp".split())
#: Elements whose content is no markup and no text of the page.
SKIPPED = RAW_TEXT | ESCAPABLE_RAW_TEXT
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[\s_-]+")


class Block(NamedTuple):
    text: str  # entities decoded, white space collapsed
    tag: str  # nearest block-level element
    path: tuple[str, ...]  # tags from the root down to `tag`
    names: tuple[str, ...]  # words of class, id and role along the path
    link_chars: int  # characters inside links
    links: int
    leaf: bool  # `tag` is one of BLOCK_ELEMENTS and holds no other of them
    ids: tuple[int, ...]  # elements of `path`, numbered in document order
    code: bool  # inside pre, code, kbd, samp or textarea for the most part


class _Open:
    __slots__ = ("name", "names", "inner", "path", "ids", "block")

    def __init__(self, name: str, names: tuple[str, ...], path: tuple[str, ...], ids: tuple[int, ...], block: bool):
        self.name, self.names, self.path, self.ids, self.block, self.inner = name, names, path, ids, block, False


def leaf_blocks(html: str | None) -> list[Block]:
    """Blocks in document order. Null and empty pages have none; text outside any element counts as a block of `body`."""
    if not html:
        return []
    root = _Open("body", (), ("body",), (0,), False)
    stack = [root]
    found: list[tuple[str, _Open, int, int, bool]] = []
    text: list[str] = []
    link_text = links = code_text = blank = number = 0
    in_link = False
    code = 0
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal link_text, links, code_text, blank
        if text:
            whole = "".join(text)
            text.clear()
            shown = 2 * code_text > blank + len(whole)
            if "&" in whole:
                whole = unescape(whole)
            whole = " ".join(whole.split())
            if whole:
                top = stack[-1]
                found.append((whole, top, link_text, links, shown or top.name == "pre"))
        link_text = links = code_text = blank = 0

    while at < size:
        for hit in TAG.finditer(html, at):
            start = hit.start()
            if start > at:
                piece = html[at:start]
                # white space before a block's text only counts for the share of code
                if text or not piece.isspace():
                    text.append(piece)
                else:
                    blank += start - at
                if in_link:
                    link_text += start - at
                if code:
                    code_text += start - at
            at = hit.end()
            slash, name, attrs = hit.groups()
            if name is None:
                continue
            name = name.lower()
            if slash:
                if name == "a":
                    in_link = False
                elif name in CODE:
                    code = max(0, code - 1)
                if name in EDGES:
                    if stack[-1].name == name:
                        flush()
                        if len(stack) > 1:
                            stack.pop()
                        continue
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].name == name:
                            flush()
                            del stack[k:]
                            break
                    else:
                        flush()
                continue
            if name in SKIPPED:
                at = raw_end(html, name, at)[1]
                break  # the scan goes on behind it
            if name == "a":
                in_link, links = True, links + 1
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in CODE:
                code += 1
            if name not in EDGES:
                continue
            flush()
            if name in ("html", "body"):
                if name == "body":
                    root.names = _names(attrs)
                continue
            if name in CLOSES_P and stack[-1].name == "p":
                stack.pop()
            if name in IMPLIED_END:
                ends, bounds = IMPLIED_END[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ends:
                        del stack[k:]
                        break
                    if stack[k].name in bounds:
                        break
            if name in VOID:
                continue
            top = stack[-1]
            block = name in BLOCK_ELEMENTS
            if block:
                for x in reversed(stack):
                    if x.inner:
                        break
                    x.inner = True
            names = top.names + _names(attrs) if attrs and "=" in attrs else top.names
            if not attrs.endswith("/"):
                number += 1
                stack.append(_Open(name, names, (*top.path, name), (*top.ids, number), block))
        else:
            text.append(html[at:])
            break
    flush()
    return [Block(whole, o.name, o.path, o.names, a, n, o.block and not o.inner, o.ids, c) for whole, o, a, n, c in found]


@lru_cache(maxsize=4096)
def _names(attrs: str) -> tuple[str, ...]:
    """Words of class, id and role; parts that hold digits are generated and say nothing."""
    return tuple(w for a, b, c in _NAMED.findall(attrs) for w in _SPLIT.split((a or b or c).lower()) if w.isalpha())
