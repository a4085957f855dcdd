"""Byte-level BPE of a public vocabulary, for whole partitions at a time.

Splitting is a handful of array operations over the code points of many documents.  The distinct pieces of a slice of a
partition are then merged together: an index maps every rank to all positions of its pair, active ranks are applied in ascending order,
and each application updates the lists of the neighbouring pairs.  Pieces seen before are taken from what the task knows.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points that are split at once.
_SLICE_CHARS = 1 << 20
#: Longer pieces are told apart by their text, shorter ones by two 64-bit hashes, or by their text where only one agrees.
_LONG = 256
#: A packed id; the vocabularies have less than 65,536.
ID_TYPE, ID_BYTES = "<u2", 2
#: Pieces that a task remembers before it starts anew.
_MOST_PIECES = 1_000_000
_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE = 0, 1, 2, 3, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)

# --- fixed values: white space of Unicode, and the endings that the split pattern takes first ---------------------------
_WHITE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: letters and digits of Unicode 16, by which the tokenizer splits; Python's own tables may be older
_LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
_DIGITS_16 = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]
_ONE_LETTER, _TWO_LETTERS = "stmd", ("re", "ve", "ll")
# --------------------------------------------------------------------------------------------------------------------------


@cache
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        first = unicodedata.category(chr(cp))[0]
        if first == "L":
            table[cp] = _LETTER
        elif first == "N":
            table[cp] = _NUMBER
    for ranges, kind in ((_LETTERS_16, _LETTER), (_DIGITS_16, _NUMBER)):
        for low, high in ranges:
            table[low : high + 1] = kind
    table[_WHITE] = _BLANK
    table[32] = _SPACE
    return table


def _byte_symbols() -> dict[str, int]:
    """The printable character that the vocabulary file writes for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Byte ids and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        if max(ids.values()) >= 1 << 8 * ID_BYTES:
            raise ValueError(f"ids of {path} don't fit {ID_BYTES} bytes")
        symbols = _byte_symbols()
        self.byte_ids = [0] * 256
        for symbol, byte in symbols.items():
            self.byte_ids[byte] = ids[symbol]
        #: left id << 32 | right id -> (rank, id of both together)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault(ids[left] << 32 | ids[right], (rank, ids[left + right]))


def merge_pieces(pieces: Sequence[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of every piece. All pieces are merged together by the pair occurrence index."""
    byte_ids, merges = vocabulary.byte_ids, vocabulary.merges
    ids: list[int] = []
    after: list[int] = []
    before: list[int] = []
    starts: list[int] = []
    for piece in pieces:
        at, n = len(ids), len(piece)
        starts.append(at)
        if not n:
            continue
        ids += [byte_ids[b] for b in piece]
        after += range(at + 1, at + n)
        after.append(-1)
        before.append(-1)
        before += range(at, at + n - 1)
    occurrences: dict[int, list[int]] = {}
    pairs: dict[int, tuple[int, int, int]] = {}
    get = merges.get
    for at, right in enumerate(after):
        if right >= 0 and (found := get(ids[at] << 32 | ids[right])) is not None:
            rank = found[0]
            if rank in occurrences:
                occurrences[rank].append(at)
            else:
                occurrences[rank] = [at]
                pairs[rank] = (ids[at], ids[right], found[1])
    active = list(occurrences)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, whole = pairs[rank]
        positions = occurrences.pop(rank)
        positions.sort()  # leftmost first where occurrences overlap
        for at in positions:
            other = after[at]
            if other < 0 or ids[at] != left or ids[other] != right:
                continue  # an earlier merge took a part of it
            ids[at], ids[other] = whole, -1
            following = after[at] = after[other]
            after[other] = -1
            preceding = before[at]
            if following >= 0:
                before[following] = at
                if (found := get(whole << 32 | ids[following])) is not None:
                    if found[0] in occurrences:
                        occurrences[found[0]].append(at)
                    else:
                        occurrences[found[0]] = [at]
                        pairs[found[0]] = (whole, ids[following], found[1])
                        heapq.heappush(active, found[0])
            if preceding >= 0 and (found := get(ids[preceding] << 32 | whole)) is not None:
                if found[0] in occurrences:
                    occurrences[found[0]].append(preceding)
                else:
                    occurrences[found[0]] = [preceding]
                    pairs[found[0]] = (ids[preceding], whole, found[1])
                    heapq.heappush(active, found[0])
    ends = [*starts[1:], len(ids)]
    return [[x for x in ids[a:b] if x >= 0] for a, b in zip(starts, ends)]


class Encoder:
    """Encodes lists of texts; keeps the pieces that it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.table = _classes()
        self._power = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.empty(0, np.uint64)
        self._others = np.empty(0, np.uint64)
        self._places = np.empty((0, 2), np.int64)  # start and length in the pool
        self._pool = np.empty(0, np.int32)
        self._long: dict[str, tuple[int, int]] = {}

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._power) < n:
            self._power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)], dtype=np.uint64)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self._inverse = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)], dtype=np.uint64)
        return self._power, self._inverse

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces begin, as a mask over code points. `first` marks the first code point of each text."""
        n = len(points)
        kind = self.table[points]
        last = np.r_[first[1:], True]
        space = kind >= _BLANK
        previous = np.r_[np.uint8(255), kind[:-1]]
        previous[first] = 255
        following = np.r_[space[1:], True]
        following[last] = True  # the end of a text counts as white space
        begin = first | (kind != previous)
        was_space = (previous == _BLANK) | (previous == _SPACE)
        # a run of white space is one piece, but for its last character when text follows
        inner = space & was_space
        begin[inner] = False
        begin |= space & ~following
        # a plain space joins the text that follows it
        begin &= ~(~space & (previous == _SPACE))
        # endings after an apostrophe that begins a piece
        mark = np.flatnonzero((points == 39) & (previous != _OTHER) & (previous != _SPACE) & ~last)
        if len(mark):
            one = np.isin(points[mark + 1], [ord(c) for c in _ONE_LETTER])
            room = (mark + 2 < n) & ~last[mark + 1]
            second = points[np.minimum(mark + 2, n - 1)]
            two = np.zeros(len(mark), bool)
            for a, b in _TWO_LETTERS:
                two |= room & (points[mark + 1] == ord(a)) & (second == ord(b))
            hits = one | two
            mark, length = mark[hits], np.where(one[hits], 2, 3)
            begin[mark + 1] = False
            ends = mark + length
            begin[ends[ends < n]] = True
        return begin

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        counts = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= _SLICE_CHARS):
                chars += len(texts[end])
                end += 1
            if chars:
                ids, counts[at:end] = self._slice(texts[at:end])
                parts.append(ids)
            at = end
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), counts

    def _slice(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths) - lengths
        n = len(points)
        first = np.zeros(n, bool)
        first[begins[lengths > 0]] = True
        starts = np.flatnonzero(self.starts(points, first))
        ends = np.r_[starts[1:], n]
        power, inverse = self._powers(n + 1)
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        sizes = (ends - starts).astype(np.uint64)

        def hashed(values: np.ndarray, of_size: np.uint64) -> np.ndarray:
            total = np.r_[np.uint64(0), np.cumsum(values * power[:n], dtype=np.uint64)]
            return (total[ends] - total[starts]) * inverse[starts] + sizes * of_size

        hashes = hashed(mixed, np.uint64(0xFF51AFD7ED558CCD))
        mixed *= np.uint64(0xC4CEB9FE1A85EC53)
        mixed ^= mixed >> np.uint64(29)
        places = self._places_of(whole, hashes, hashed(mixed, np.uint64(0x9FB21C651E98DF25)), starts, ends)
        lens = places[:, 1]
        out = np.cumsum(lens)
        shift = np.repeat(places[:, 0] - (out - lens), lens)
        ids = self._pool[shift + np.arange(len(shift))]
        until = np.searchsorted(starts, begins + lengths)  # pieces up to each text's end
        running = np.r_[0, out]
        return ids, np.diff(np.r_[0, running[until]])

    def _places_of(self, whole: str, hashes: np.ndarray, others: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self._hashes) + len(self._long) > _MOST_PIECES:
            self._forget()
        long = ends - starts > _LONG
        while True:
            distinct, sample, inverse = np.unique(hashes[~long], return_index=True, return_inverse=True)
            second = others[~long]
            at = np.searchsorted(self._hashes, distinct)
            known = np.zeros(len(distinct), bool)
            inside = at < len(self._hashes)
            known[inside] = self._hashes[at[inside]] == distinct[inside]
            # a piece with the first hash of another one is told apart by its text, as long ones are
            clash = np.zeros(len(distinct), bool)
            clash[known] = self._others[at[known]] != second[sample[known]]
            odd = clash[inverse] | (second != second[sample][inverse])
            if not odd.any():
                break
            long[np.flatnonzero(~long)[odd]] = True
        new = np.flatnonzero(~known)
        short_starts, short_ends = starts[~long], ends[~long]
        texts = [whole[short_starts[k] : short_ends[k]] for k in sample[new]]
        long_at = np.flatnonzero(long)
        long_texts = [whole[starts[k] : ends[k]] for k in long_at]
        fresh = list(dict.fromkeys(x for x in long_texts if x not in self._long))
        if texts or fresh:
            made = merge_pieces([x.encode() for x in [*texts, *fresh]], self.vocabulary)
            lens = np.fromiter(map(len, made), np.int64, len(made))
            begin = len(self._pool) + np.cumsum(lens) - lens
            self._pool = np.concatenate([self._pool, np.fromiter((x for ids in made for x in ids), np.int32, int(lens.sum()))])
            rows = np.stack([begin, lens], 1)
            where = at[new]
            self._hashes = np.insert(self._hashes, where, distinct[new])
            self._others = np.insert(self._others, where, second[sample[new]])
            self._places = np.insert(self._places, where, rows[: len(texts)], axis=0)
            for x, row in zip(fresh, rows[len(texts) :]):
                self._long[x] = (int(row[0]), int(row[1]))
        result = np.empty((len(starts), 2), np.int64)
        result[~long] = self._places[np.searchsorted(self._hashes, distinct)][inverse]
        for k, x in zip(long_at, long_texts):
            result[k] = self._long[x]
        return result


def encode_texts(df: DataFrame, keys: Sequence[str], text: str, path: str, form: str = "ids") -> DataFrame:
    """`keys` and the tokens of each row's text, whole and without special tokens, in one of three forms:

    ids: array<int>; count: tokens bigint; packed: tokens bigint and ids as bytes, ID_BYTES little-endian ones for each.
    Null and empty texts have no ids: an empty list, 0 tokens. `path` names a tokenizer file on every machine.
    """
    kinds = dict(df.dtypes)
    made = {"ids": "ids array<int>", "count": "tokens bigint", "packed": "tokens bigint, ids binary"}[form]
    names = [*keys, *[part.split()[0] for part in made.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(path))
        for batch in batches:
            ids, sizes = encoder.encode([x or "" for x in batch.column(len(keys)).to_pylist()])
            ends = np.r_[0, np.cumsum(sizes)]
            if form == "ids":
                columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
            else:
                columns = [pa.array(sizes)]
                if form == "packed":
                    raw = ids.astype(ID_TYPE)
                    buffers = [None, pa.array(ends * ID_BYTES, pa.int32()).buffers()[1], pa.py_buffer(raw)]
                    columns.append(pa.Array.from_buffers(pa.binary(), len(sizes), buffers))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names)

    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return df.select(*keys, text).mapInArrow(run, f"{ddl}, {made}")
