"""What a block of text says about residue by itself, and the texts that are trusted to be residue.

By themselves blocks show unfilled placeholders (by their syntax) and random filler (by its vocabulary).  Everything else is
told by nearness to trusted texts, which `residue` looks for; the few below are only the beginning.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product
from auditloom.llm.blocks import Block

ORDINARY, NOTICE, FILLER, PLACEHOLDER = 0, 1, 2, 3

# --- fixed values: placeholder syntaxes of template languages and mail merges --------------------------------------------
_NAME = r"[A-Za-z][\w.]*(?: [A-Za-z][\w.]*){0,3}"
PLACEHOLDERS = re.compile(
    r"\{\{\{?\s*" + _NAME + r"(?:\s*\|[^{}]*)?\s*\}?\}\}"  # {{ name }}
    r"|(?<![\w{])[$#]?\{(?:" + _NAME + r"|\d{1,2})\}(?!\})"  # {name} ${name} #{name} {0}
    r"|\{%-?\s*\w[^{}%]*%\}"  # {% block name %}
    r"|<%[=-]?\s*\w[^<>%]*%>"  # <%= name %>
    r"|<\?(?:=|php)\s*\$?\w[^<>?]*\?>"  # <?= $name ?>
    r"|%%[A-Za-z]\w*%%|(?<![\w%])%[A-Z][A-Z0-9_]+%(?![\w%])"
    r"|@@[A-Za-z]\w*@@|(?<!\w)__[A-Z][A-Z0-9_]*__(?!\w)|(?<![\w$])\$[A-Z][A-Z0-9_]+\$(?![\w$])"
    r"|\*\|[A-Z][A-Z0-9_:]*\|\*"
    r"|\[\[\s*" + _NAME + r"\s*\]\]"
    r"|\[(?:insert\b[^\[\]]{0,40}|(?:tbd|todo)\b[^\[\]]{0,40}|your [a-z ]{2,30}|phone(?: number)?|date|name|company(?: name)?"
    r"|address|e-?mail(?: address)?|city|price|title|headline|product(?: name)?|first name|last name)\]",
    re.I,
)
_MARKS = re.compile(r"[{%\[@_$*«<]")
_CASED = re.compile(r"%[A-Z][A-Z0-9_]+%|__[A-Z][A-Z0-9_]*__|\$[A-Z][A-Z0-9_]+\$|\*\|[A-Z][A-Z0-9_:]*\|\*")
#: names that templates fill in, for syntaxes that ordinary text uses too
_SLOTS = (
    r"(?:brand|city|company|customer(?:[._ ]\w+)?|first[._ ]?name|headline|(?:insert|your)[._ ]\w+|opening[._ ]?hours|"
    r"page[._ ]\w+|phone|price|product(?:[._ ]\w+)?|site(?:[._ ]\w+)?|title|text)"
)
_GUILLEMETS = re.compile(r"«\s?" + _SLOTS + r"\s?»", re.I)
# --- fixed values: vocabulary of random filler ----------------------------------------------------------------------------
LATIN = frozenset(
    "ad adipiscing aliqua aliquam amet consectetur cupidatat dolor dolore eiusmod elit enim est et incididunt ipsum labore "
    "laborum lorem magna minim mollit nisi non nostrud nulla officia pariatur quis sed sit tempor ullamco ut velit veniam".split()
)
#: of the Latin words one or two of these must be there
_LATIN_SURE = frozenset("lorem ipsum amet adipiscing consectetur dolor minim enim quis".split())
#: words that Latin filler never holds
_LIVING = frozenset("the and of to a in is with for der die das und ein le la les des une el los las una".split())
#: words that people type to fill a space
MASHED = frozenset("foo bar baz qux quux asdf asdfgh sdfg qwer qwert qwerty zxcv hjkl blah bla yada test testing dummy xxx xyz abc tbd todo".split())
# --- fixed values: texts that are trusted to be notices or filler. Servers send notices about scripts with status 200, so
# --- these are given as first part x second part; a filler text may have a second sentence ---------------------------------
NOTICES = (
    "Your browser does not support scripts", "404 Not Found", "Page not found", "403 Forbidden", "Access denied",
    "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Time-out", "Loading", "Please wait",
)
SCRIPT_NOTICES = (
    ("Please enable JavaScript", "You need to enable JavaScript", "Activate JavaScript", "Turn on JavaScript"),
    ("to run this app", "to view this page", "to continue", "in your browser and reload"),
    ("This site requires", "This site relies on", "This site works only with"),
    ("JavaScript", "JavaScript and cookies", "a browser with scripting"),
)
FILLERS = (
    "Your text goes here", "Title goes here", "Add your own text here", "Click to edit this text", "Type your paragraph here",
    "Sample paragraph 1. This is dummy copy", "Sample paragraph 1. This is dummy copy, swap it out later", "xxx text follows", "Hier steht ein Blindtext, der später ersetzt wird",
    "Platzhaltertext: bitte Inhalt einfügen", "Texte provisoire à remplacer avant la mise en ligne",
    "Texto de ejemplo, sustituir antes de publicar",
)
FILLER_ENDS = ("", "Replace it before launch", "Double click to change the font", "Tell visitors about your business")
# ----------------------------------------------------------------------------------------------------------------------------

_EDGES = " \t.,;:!?…'\"„“”‘’()<>|*·•-–—"
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ERROR_CODE = re.compile(r"[45]\d\d")
_MASHED_STARTS = frozenset(w[:3] for w in MASHED)


def has_placeholder(text: str) -> bool:
    """An unfilled slot. Syntaxes that are told by their capitals must have them."""
    if _MARKS.search(text) is None:
        return False
    for hit in PLACEHOLDERS.finditer(text):
        slot = hit.group()
        if slot[0] in "%_$*" and not slot.startswith(("%%", "${")):
            if not _CASED.fullmatch(slot):
                continue
        return True
    return bool(_GUILLEMETS.search(text))


def _is_mashed(text: str) -> bool:
    """Three words or more, nearly all of them typed to fill a space."""
    words = _LETTERS.findall(text.lower())
    return len(words) >= 3 and sum(w in MASHED for w in words) >= 0.8 * len(words)


def _is_latin(text: str) -> bool:
    low = text.lower()
    if not any([w in low for w in _LATIN_SURE]):
        return False
    words = _LETTERS.findall(low)
    living = sum(w in _LIVING for w in words)
    if len(words) < 4 or living > 0.05 * len(words):
        return False
    known = sum(w in LATIN for w in words)
    sure = sum(w in _LATIN_SURE for w in words)
    if low.startswith("lorem ipsum"):
        return True
    return known >= 3 and known >= 0.25 * len(words) and sure >= (2 if living else 1)


def block_kind(block: Block) -> int:
    """Kind of one block of a main body, by itself. Code is never residue."""
    if block.code:
        return ORDINARY
    text = block.text
    if has_placeholder(text):
        return PLACEHOLDER
    if _is_latin(text) or (text[:3].lower() in _MASHED_STARTS and _is_mashed(text)):
        return FILLER
    return ORDINARY


@lru_cache(maxsize=100_000)
def _masked(word: str) -> str:
    """A word without marks around it, empty if nothing is left; 0 for what is no word."""
    if word.isalpha():
        return word
    word = word.strip(_EDGES)
    if not word or word.isalpha() or _PLAIN.fullmatch(word) or _ERROR_CODE.fullmatch(word):
        return word
    return "0"


def masked_words(text: str) -> list[str]:
    """Words in lower case without marks around them; what is no word (addresses, numbers but error codes, ids) is 0."""
    return [w for w in map(_masked, text.lower().split()) if w]


def trusted_texts() -> list[tuple[int, str]]:
    """Kind and text of the texts that are trusted from the start."""
    ask, wish, need, what = SCRIPT_NOTICES
    scripts = [f"{a} {b}" for a, b in [*product(ask, wish), *product(need, what)]]
    fillers = [f"{a}. {b}" for a, b in product(FILLERS, FILLER_ENDS)]
    return [(NOTICE, t) for t in (*NOTICES, *scripts)] + [(FILLER, t) for t in fillers]
