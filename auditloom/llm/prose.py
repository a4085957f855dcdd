"""Running English prose of a document: what is left without link lists, metrics, logs, code and other languages."""

from __future__ import annotations

import re
from collections.abc import Iterator

# --- fixed values: frequent function words of English and of the languages it has to be told from ------------------------
ENGLISH = frozenset(
    "a about after all also an and any are as at be because been before but by can could did do down each even first for "
    "from had has have he her him his how i if in into is it its just like made many may me more most much must my new no "
    "not now of on once one only or other our out over own people put said she should so some such than that the their "
    "them then there these they this those through time to too two under up us was we well were what when where which who "
    "will with would you your".split()
)
_GERMAN = (
    "aber auch auf aus bei bis das dass dem den der des die durch ein eine einem einer für haben hat ihr im ist jede jeden "
    "kaum mit nach neben nicht noch nur ob oder ohne seit sich sie sind um und uns unsere vom von vor wer werden wie wir "
    "wird wurde zu zum zur"
)
_FRENCH = (
    "après au aussi aux avant avec ce cette chaque dans de des du elle en entre est et il ils je la le les leur mais ne "
    "nos notre nous on ou par pas pour puis qui sa sans se ses son sont sur tous une votre vous à été"
)
_SPANISH = (
    "a antes cada como con cuando de del desde después donde durante el ella en entre es esta este hasta hay la las lo los "
    "luego más muy nos para pero por porque que se ser sin sobre su sus también un una unas uno y ya"
)
# --------------------------------------------------------------------------------------------------------------------------
OTHERS = tuple(frozenset(words.split()) - ENGLISH for words in (_GERMAN, _FRENCH, _SPANISH))
_ANY_OTHER = frozenset().union(*OTHERS)

#: Least words of a piece of prose, and least share of plain words among its tokens.
LEAST_WORDS, LEAST_PLAIN = 3, 0.6

_STOP = re.compile(r"[.!?…]+[\"”’)\]]*\s")
_ODD = re.compile(r"[{}<>=|/\\@_\[\].:]")
_ODD_TOKEN = re.compile(r"\S*(?:[{}<>=|/\\@_\[\]]|\w[.:]\w)\S*")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_LABEL = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)?: ")


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Sentences of every line, and whether a full stop or the like ends them."""
    for line in text.split("\n"):
        at = 0
        for stop in _STOP.finditer(line):
            yield line[at : stop.start()], True
            at = stop.end()
        rest = line[at:].strip()
        if rest:
            yield rest, rest[-1] in ".!?…"


def english_prose(text: str | None) -> list[str]:
    """Lower-case words of the English sentences of a text, in order.

    A sentence counts if it has several words, mostly plain ones, and more function words of English than of any other
    language. One without any function word counts where English prevails in the whole text, unless it is a list
    (commas without a full stop) or a label with values.
    """
    if not text:
        return []
    kept: list[list[str]] = []
    unsure: list[tuple[int, list[str]]] = []
    english = foreign = 0
    is_english, is_other = ENGLISH.__contains__, _ANY_OTHER.__contains__
    low = text.lower()
    for piece, stopped in _pieces(text.lower()):
        tokens = piece.count(" ") + 1
        if tokens < LEAST_WORDS:
            continue
        if _ODD.search(piece):
            piece = _ODD_TOKEN.sub(" ", piece)
        words = _WORD.findall(piece)
        if len(words) < LEAST_WORDS or len(words) < LEAST_PLAIN * tokens:
            continue
        n = sum(map(is_english, words))
        m = sum(map(is_other, words))
        if m and m >= n:
            m = max(sum(map(words_of.__contains__, words)) for words_of in OTHERS)
        english, foreign = english + n, foreign + m
        if n > m:
            kept.append(words)
        elif not n and not m:
            if stopped or (piece.count(",") < 2 and len(words) > 4 and not _LABEL.match(piece)):
                unsure.append((len(kept), words))
    if english > foreign:
        for place, words in reversed(unsure):
            kept.insert(place, words)
    return [w for words in kept for w in words]
