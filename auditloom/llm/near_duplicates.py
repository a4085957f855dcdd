"""Near-duplicate records with small edits.

1. A text becomes its set of word sequences.  Equal sets form one class; only one representative goes on, so groups of
   copies, however large, cost one row.
2. A class gets a sketch of 128 bits (one bit of each of 128 minimum hashes: two sets differ in about (1 - J) / 2 of the
   bits) and 32 bucket keys (four minimum hashes each).
3. Within each bucket sketches are compared bit-sliced: bit planes are stored vertically, one machine word holds the same
   bit of 64 pairs, distances of all pairs grow at once in carry-save counters, and a block of pairs is abandoned as soon as
   all of them exceed the radius.  Buckets with many members are cut into tiles that are compared two by two in different
   tasks, so none is too large for a task and no pair is lost.
4. Pairs within the radius are verified on the whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.operators.hot import hot_keys, split_join
from auditloom.session import written

SKETCH_BITS = 128
BUCKETS = 32
ROWS = 4  # minimum hashes in a bucket key; BUCKETS * ROWS = SKETCH_BITS
#: Most differing sketch bits. At a similarity of 0.7 a pair differs in 19 of 128 bits (standard deviation 4), at 0.8 in 13.
RADIUS = 40
#: Members of a bucket that one task compares; larger buckets are tiled.
TILE = 256
_LANES = 1 << 15  # pairs that are compared at once
_WORD = re.compile(r"[^\W_]+")
_MULTIPLY = np.random.default_rng(20240229).integers(1, 2**63, SKETCH_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower case."""
    return _WORD.findall(text.lower())


class _Hashes(dict[str, int]):
    """64-bit hashes of words, made when they are first asked for."""

    def __missing__(self, word: str) -> int:
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


class Sketcher:
    """Class key, sketch and bucket keys of word lists. Hashes of known words are kept within a bound."""

    MOST_WORDS = 300_000

    def __init__(self, shingle: int):
        if not 1 <= shingle <= len(_PLACE):
            raise ValueError(f"shingle must be 1 to {len(_PLACE)} words")
        self.shingle = shingle
        self._hashes = _Hashes()

    def sequences(self, words: Sequence[str]) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the word sequences; of a shorter text its words together are the only one."""
        if not words:
            return np.empty(0, np.uint64)
        known = self._hashes
        if len(known) > self.MOST_WORDS:
            known.clear()
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(one) - self.shingle + 1)
        whole = np.zeros(n, np.uint64)
        for k in range(min(self.shingle, len(one))):
            whole += (one[k : k + n] ^ (one[k : k + n] >> np.uint64(31))) * _PLACE[k]
        whole ^= whole >> np.uint64(29)
        whole *= np.uint64(0xBF58476D1CE4E5B9)
        whole ^= whole >> np.uint64(32)
        return np.unique(whole)

    def __call__(self, words: Sequence[str]) -> tuple[bytes, bytes, np.ndarray] | None:
        """Class key (128 bits), sketch and bucket keys; None for a text without words."""
        return self.many([words])[0]

    def many(self, texts: Sequence[Sequence[str]]) -> list[tuple[bytes, bytes, np.ndarray] | None]:
        """The same for each of many texts."""
        least = np.full((len(texts), SKETCH_BITS), np.iinfo(np.uint64).max, np.uint64)
        classes: list[bytes | None] = []
        for low, words in zip(least, texts):
            hashes = self.sequences(words)
            classes.append(xxhash.xxh128_digest(hashes.tobytes()) if len(hashes) else None)
            for at in range(0, len(hashes), 4096):  # bounds memory on very long texts
                part = hashes[at : at + 4096, None] * _MULTIPLY
                np.minimum(low, part.min(0), out=low)
        mixed = (least ^ (least >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        sketches = np.packbits((mixed >> np.uint64(63)).astype(np.uint8), axis=1)
        rows = least.reshape(-1, BUCKETS, ROWS)
        keys = np.tile(np.arange(BUCKETS, dtype=np.uint64), (len(texts), 1))
        for k in range(ROWS):
            keys = (keys ^ rows[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(32)
        return [c and (c, s.tobytes(), k) for c, s, k in zip(classes, sketches, keys.view(np.int64))]


def within_radius(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which pairs of sketches (rows of bytes) differ in at most `radius` bits, bit-sliced.

    Lane p of a bit plane holds one bit of pair p. Planes are added three at a time by carry-save adders into counter planes;
    after every 32 planes words of 64 lanes whose counters all exceed the radius are abandoned.
    """
    n = len(left)
    if not n:
        return np.zeros(0, bool)
    lanes = -(-n // 64) * 64
    bits = np.zeros((lanes, left.shape[1] * 8), np.uint8)
    bits[:n] = np.unpackbits(left ^ right, axis=1)
    bits[n:] = 1
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.uint64)  # bit k of 64 pairs in one word
    words = np.arange(planes.shape[1])
    levels = (left.shape[1] * 8).bit_length()
    counter = np.zeros((levels, len(words)), np.uint64)
    result = np.zeros(planes.shape[1], np.uint64)
    for start in range(0, len(planes), 32):
        for k in range(start, min(start + 32, len(planes)), 2):
            a = planes[k]
            b = planes[k + 1] if k + 1 < len(planes) else np.zeros_like(a)
            ones = counter[0]
            half = a ^ b
            carry = (a & b) | (half & ones)
            counter[0] = half ^ ones
            for level in range(1, levels):
                if not carry.any():
                    break
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
        alive = ~_exceeds(counter, radius)
        keep = alive != 0
        if not keep.all():
            planes, counter, words, alive = planes[:, keep], counter[:, keep], words[keep], alive[keep]
            if not len(words):
                break
    result[words] = alive if len(words) else 0
    return np.unpackbits(result.view(np.uint8))[:n].astype(bool)


def _exceeds(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical counter is greater than `radius`, compared from the highest bit down."""
    greater = np.zeros(counter.shape[1], np.uint64)
    equal = ~greater
    for level in range(len(counter) - 1, -1, -1):
        if radius >> level & 1:
            equal = equal & counter[level]
        else:
            greater |= equal & counter[level]
            equal = equal & ~counter[level]
    return greater


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Pairs within the radius, from rows (bucket, tiles, tile, id, sketch) sorted by bucket and tiles."""
    held: list[pa.RecordBatch] = []

    def ready(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = table["bucket"].to_numpy()
        tiles = table["tiles"].to_numpy()
        tile = table["tile"].to_numpy()
        ids = table["id"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (tiles[1:] != tiles[:-1])]
        starts = np.r_[np.flatnonzero(new), len(ids)]
        sizes = np.diff(starts)
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        pending = 0

        def emit() -> Iterator[pa.RecordBatch]:
            a, b = np.concatenate(left), np.concatenate(right)
            for at in range(0, len(a), _LANES):
                x, y = a[at : at + _LANES], b[at : at + _LANES]
                near = within_radius(sketch[x], sketch[y], radius)
                p, q = ids[x[near]], ids[y[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["id_a", "id_b"])

        twos = starts[:-1][sizes == 2]
        if len(twos):
            left.append(twos)
            right.append(twos + 1)
            pending += len(twos)
        for k in np.flatnonzero(sizes > 2):
            at, n = starts[k], sizes[k]
            code = tiles[at]
            if code >> 32 == code & 0xFFFFFFFF:  # a tile with itself
                x, y = np.triu_indices(n, 1)
            else:
                first = tile[at : at + n] == code >> 32
                x, y = (z.ravel() for z in np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first), indexing="ij"))
            left.append(x + at)
            right.append(y + at)
            pending += len(x)
            if pending >= _LANES:
                yield from emit()
                left.clear(), right.clear()
                pending = 0
        if left:
            yield from emit()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        bucket, tiles = table["bucket"].to_numpy(), table["tiles"].to_numpy()
        other = np.flatnonzero((bucket != bucket[-1]) | (tiles != tiles[-1]))
        if not len(other):
            continue  # a group is not larger than two tiles
        end = int(other[-1]) + 1
        yield from ready(table.slice(0, end).combine_chunks())
        held = table.slice(end).combine_chunks().to_batches()
    if held:
        yield from ready(pa.Table.from_batches(held).combine_chunks())


def close_pairs(sketches: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct pairs (id_a < id_b) of rows (id bigint, sketch binary, buckets array) that share a bucket and differ in at
    most `radius` bits."""
    exploded = sketches.select("id", "sketch", F.explode("buckets").alias("bucket"))
    # which buckets matter is found from their keys alone; the rows of hot ones are split before they meet their sizes
    sizes = written(exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets")
    member = split_join(exploded, sizes, "bucket", hot_keys(sizes, "bucket"), F.col("id"))
    tiled = member.withColumn("of", F.ceil(F.col("n") / TILE).cast("int")).withColumn(
        "tile", F.pmod(F.xxhash64("id"), F.col("of")).cast("int")
    )
    # tile t meets every tile: code = lesser << 32 | greater
    code = F.transform(
        F.sequence(F.lit(0), F.col("of") - 1),
        lambda k: F.shiftleft(F.least(k, F.col("tile")).cast("bigint"), 32) + F.greatest(k, F.col("tile")).cast("bigint"),
    )
    rows = tiled.select("bucket", F.explode(code).alias("tiles"), "tile", "id", "sketch")
    grouped = rows.repartition("bucket", "tiles").sortWithinPartitions("bucket", "tiles")
    pairs = grouped.mapInArrow(lambda batches: _compare(batches, radius), "id_a bigint, id_b bigint")
    return pairs.distinct()


def similarity(shingle: int):
    """Arrow UDF: Jaccard similarity of the word sequences of two texts, whose words are separated by blanks."""

    @F.pandas_udf(T.DoubleType())
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        sketcher = Sketcher(shingle)

        def one(x: str, y: str) -> float:
            p, q = sketcher.sequences(x.split()), sketcher.sequences(y.split())
            common = len(np.intersect1d(p, q, assume_unique=True))
            return common / (len(p) + len(q) - common) if common else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return of


def class_heads(members: DataFrame) -> DataFrame:
    """class, id (the least of its members) and n (members) of every class. Copies of a row count once."""
    return members.select("class", "id").distinct().groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def class_links(members: DataFrame, alike: Callable[[Column, Column], Column], radius: int = RADIUS) -> DataFrame:
    """Links id_a < id_b between class representatives whose bodies are `alike`.

    `members` is a written table of id, class, sketch, buckets and body. Representative of a class is its least id.
    """
    heads = class_heads(members).select("id")
    slim = members.select("id", "sketch", "buckets").join(heads, "id", "left_semi").dropDuplicates(["id"])
    near = written(close_pairs(written(slim, "near-heads"), radius), "near-pairs")
    wanted = near.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    texts = members.select("id", "body").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    a, b = texts.toDF("id_a", "body_a"), texts.toDF("id_b", "body_b")
    both = near.join(a, "id_a").join(b, "id_b")
    return both.where(alike(F.col("body_a"), F.col("body_b"))).select("id_a", "id_b")


def linked_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, class_id (its class's least member) and links (to other classes) of every member, each once.

    The form for large groups of copies: its size is that of the members, whatever the number of pairs.
    """
    ends = links.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    heads = class_heads(members).join(ends, "id", "left").select("class", "n", F.col("id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    heads = written(heads, "near-classes")
    of = members.select("id", "class").distinct()
    return split_join(of, heads, "class", hot_keys(heads, "class"), F.col("id")).select("id", "class_id", "links")


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a < id_b of all members of linked classes and of the same class. `members` is (id, class), `links` between heads."""
    of = members.select("id", "class").distinct()
    head = class_heads(members).withColumnRenamed("id", "head")
    placed = written(of.join(head, "class"), "near-placed")
    shared = placed.where("n > 1").select("id", "head")
    same = shared.select(F.col("id").alias("id_a"), "head").join(shared.select(F.col("id").alias("id_b"), "head"), "head")
    x = placed.select(F.col("head").alias("id_a"), F.col("id").alias("x"))
    y = placed.select(F.col("head").alias("id_b"), F.col("id").alias("y"))
    across = links.join(x, "id_a").join(y, "id_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.where("id_a < id_b").select("id_a", "id_b").unionByName(across)


def sketch_columns(bodies: list[list[str]], sketcher: Sketcher) -> list[dict | None]:
    """class, sketch, buckets and body of word lists; None for a text without words."""
    found: list[dict | None] = []
    for words, made in zip(bodies, sketcher.many(bodies)):
        found.append(made and {"class": made[0], "sketch": made[1], "buckets": made[2].tolist(), "body": " ".join(words)})
    return found
