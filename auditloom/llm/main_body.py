"""Main body of web pages: a linear-chain CRF over leaf blocks, decoded by Viterbi.

Labelled pages come from `label_page`, a set of conservative structural rules that say for each block of a page whether
it is main body; pages on which the rules are unsure are not used.  The model sees other evidence beside names (ancestor tags,
link share, length, place relative to the page's headline, neighbours).  Half of the labelled pages lose all their names before
training, so that it has to learn that evidence and decides pages whose boilerplate carries no telling name as well.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import xxhash

from auditloom.llm.blocks import Block, leaf_blocks
from auditloom.llm.crf import Chain, fit

#: Most pages that one fit reads; the sample's only bound.
MAX_LABELLED_PAGES = 1500

_TERMINAL = frozenset(".!?…:;»\"”’')]")
_RIGHTS = re.compile(r"^\s*(?:©|\(c\)|copyright\b)", re.I)
_BUCKETS = (1, 2, 3, 4, 6, 9, 14, 24, 48)


def _bucket(n: int) -> int:
    for k, edge in enumerate(_BUCKETS):
        if n <= edge:
            return k
    return len(_BUCKETS)


def _link_share(b: Block) -> int:
    """0 no link, 1 up to a third, 2 up to three quarters, 3 (nearly) all of the text."""
    if not b.links:
        return 0
    share = b.link_chars / max(1, len(b.text))
    return 1 if share <= 0.34 else 2 if share <= 0.75 else 3


Keys = tuple[tuple, tuple, str]


def _page_keys(blocks: Sequence[Block]) -> list[Keys]:
    """What the features of each block are made of: its container, itself and its first word. Keys repeat a lot."""
    head = next((k for k, b in enumerate(blocks) if b.tag == "h1"), None)
    head_ids = blocks[head].ids[:-1] if head is not None else ()
    shares = [_link_share(b) for b in blocks]
    prose = min(3, sum(1 for b, share in zip(blocks, shares) if share < 2 and len(b.text) > 60))
    n, count = len(blocks), _bucket(len(blocks))
    keys: list[Keys] = []
    last_parent: tuple[int, ...] | None = None
    last_tag, last_rights, steps = "", False, (-1, -1)
    for k, b in enumerate(blocks):
        parent, text = b.ids[:-1], b.text
        if parent != last_parent and head is not None:
            common = 0
            for x, y in zip(parent, head_ids):
                if x != y:
                    break
                common += 1
            steps = (min(len(head_ids) - common, 4), min(len(parent) - common, 3))
        rights = text[:1] in "©(Cc" and bool(_RIGHTS.match(text))
        place = "none" if head is None else "before" if k < head else "head" if k == head else "after"
        block = (
            b.tag, prose, count, shares[k], _bucket(text.count(" ") + 1), place, text[-1] in _TERMINAL, min(n - k, 4),
            rights, last_rights, b.links > 2, last_tag if parent == last_parent else "",
        )
        keys.append(((b.path, b.names, *steps), block, text[:24].split(" ", 1)[0].lower()))
        last_parent, last_tag, last_rights = parent, b.tag, rights
    return keys


def _container_features(key: tuple) -> list[str]:
    path, names, up, down = key
    found = [f"tags={'/'.join(path[-2:])}", f"tags3={'/'.join(path[-3:])}"]
    found += [f"in={x}" for x in sorted(set(path[:-1]))]
    found += [f"name={x}" for x in sorted(set(names))]
    if names:
        found.append(f"last={names[-1]}")
    found.append(f"up={up}")
    found.append(f"up_down={min(up, 3)},{down}")
    found.append(f"up_down_tag={min(up, 3)},{down},{path[-1]}")
    return found


def _block_features(key: tuple) -> list[str]:
    tag, prose, count, links, words, place, ends, left, rights, after_rights, many, before = key
    found = [
        "bias", f"tag={tag}", f"prose={prose}", f"blocks={count}", f"links={links}", f"words={words}",
        f"links_words={links},{words}", f"place={place}", f"place_tag={place},{tag}", f"place_links={place},{links}",
        f"prose_words={prose},{tag},{words}", f"prose_place={prose},{place},{links}", f"ends={ends},{words}", f"left={left}",
    ]
    if rights:
        found.append("rights")
    if after_rights:
        found.append("after_rights")
    if many:
        found.append("many_links")
    if before:
        found.append(f"same_parent={before},{tag}")
    return found


def page_features(blocks: Sequence[Block]) -> list[list[str]]:
    """Feature names of each block of one page."""
    return [[*_container_features(c), *_block_features(b), f"first={w}"] for c, b, w in _page_keys(blocks)]


class BodyFinder:
    """Decodes pages with one model; scores of container and block keys are remembered, as templates repeat them."""

    MOST_REMEMBERED = 200_000

    def __init__(self, model: Chain):
        self.model = model
        self.containers: dict[tuple, float] = {}
        self.blocks: dict[tuple, float] = {}

    def labels(self, blocks: Sequence[Block]) -> list[int]:
        """Viterbi labels; where no block would be main body, the one with the highest score is."""
        scores: list[float] = []
        first, known_c, known_b = self.model.weights.get, self.containers, self.blocks
        for c, b, w in _page_keys(blocks):
            x = known_c.get(c)
            if x is None:
                if len(known_c) >= self.MOST_REMEMBERED:
                    known_c.clear()
                x = known_c[c] = self.model.score(_container_features(c))
            y = known_b.get(b)
            if y is None:
                if len(known_b) >= self.MOST_REMEMBERED:
                    known_b.clear()
                y = known_b[b] = self.model.score(_block_features(b))
            scores.append(x + y + first(f"first={w}", 0.0))
        labels = self.model.decode(scores)
        if scores and not any(labels):
            labels[scores.index(max(scores))] = 1  # a page with text has a body; the likeliest block is it
        return labels

    def main_blocks(self, html: str | None) -> list[Block]:
        """Blocks of the main body in document order; empty for null, empty and text-free pages."""
        blocks = leaf_blocks(html)
        return [b for b, y in zip(blocks, self.labels(blocks)) if y]


# --- fixed values: names and tags that mark boilerplate on labelled pages, in the usual vocabulary of page templates --------
_OUTSIDE_TAGS = frozenset("nav footer aside form amp-sidebar".split())
_OUTSIDE_NAMES = frozenset(
    "breadcrumb breadcrumbs colophon cookie crumbs dialog end footer ft hd legal masthead mega menu more navbar "
    "newsletter nl pagination popup promo related rel secondary share sharing social subscribe teaser teasers widget".split()
)
_SHARE = re.compile(r"^(?:(?:share|tweet|pin|print|like|e-?mail)(?: this)?\s*)+$", re.I)
# ----------------------------------------------------------------------------------------------------------------------------


def label_page(blocks: Sequence[Block]) -> list[int] | None:
    """Labels (1 main body) of a page on which the rules are sure, else None."""
    if not blocks:
        return None
    outside_noscript = any("noscript" not in b.path and "dialog" not in b.names for b in blocks)
    labels: list[int] = []
    rights = False
    for b in blocks:
        path, names = set(b.path), set(b.names)
        rights = bool(_RIGHTS.match(b.text)) or rights and b.tag == "p" and not b.links and len(b.text) < 60
        out = (
            bool(path & _OUTSIDE_TAGS)
            or bool(names & _OUTSIDE_NAMES)
            or ("header" in path and "article" not in path)
            or ("noscript" in path and outside_noscript)
            or _link_share(b) == 3
            or (b.links > 2 and _link_share(b) == 2)
            or bool(_SHARE.match(b.text))
            or rights
        )
        labels.append(0 if out else 1)
    first = [k for k, b in enumerate(blocks) if b.tag == "h1"]
    if len(first) == 1 and not labels[first[0]]:
        return None
    return labels


def train(pages: Sequence[str]) -> Chain:
    """Model from labelled pages' HTML. Copies of a page count once; pages without blocks or a sure label are left out."""
    rows, labels = [], []
    for html in sorted(set(pages)):
        blocks = leaf_blocks(html)
        marks = label_page(blocks)
        if marks is not None:
            if xxhash.xxh64_intdigest(html) & 1:
                blocks = without_names(blocks)
            rows.append(page_features(blocks))
            labels.append(marks)
    return fit(rows, labels)


def without_names(blocks: Sequence[Block]) -> list[Block]:
    """The blocks of a page as if no element had a class, id or role."""
    return [b._replace(names=()) for b in blocks]
