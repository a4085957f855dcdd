"""Mix of several sources by target shares of the total size in tokens.

1. The token streams of each source are packed into blocks of a fixed length.  A document's place in its source's stream
   is a running total in two steps: totals per partition and source (a table from which each task reads its own row), then
   within each partition while it is read, so a source may hold any part of the corpus and no document is shuffled before it
   is cut.
2. Every output shard draws its counts per source from a multinomial over what the sources still owe, in two steps: groups
   of shards from the whole mix, shards from their group.  Counts never exceed what is owed, so that the whole mix keeps its
   quotas exactly.
3. Draw number j of a source is block perm_e(j mod n) of its n blocks in pass e = j div n, by a pseudorandom permutation of
   the indexes (a Feistel network with cycle walking).  Blocks are joined by their index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.bpe import ID_BYTES, ID_TYPE
from auditloom.session import scratch_rows, write_scratch, written

#: Tokens of a block; only a source's last block may be shorter.
BLOCK_TOKENS = 1024
#: Blocks of an output shard; only the last shard may have fewer.
SHARD_BLOCKS = 256
#: Shards of a group. Counts are drawn for groups on the driver (one short row for each group and source, so some 200,000 for
#: 25 trillion tokens), and in tasks for the shards of each group.
GROUP_SHARDS = 4096
#: Parts into which the places of partitions are laid out.
OFFSET_PARTS = 256
_ROUNDS = 4


@dataclass(frozen=True)
class Quota:
    source: str
    target_share: float
    blocks: int
    most: int
    drawn: int


def quotas(sources: Sequence[tuple[str, float, int, int]], total: int | None = None) -> list[Quota]:
    """Blocks to draw from each (source, target_share, max_repeats, blocks).

    `total` blocks are shared out by the target shares, as many as the sources hold if it is not given. A source can give
    at most max_repeats times its blocks; what it can't give goes to the others by their shares, and if no source is left,
    the mix gets smaller. Fractions go to the largest remainders, of equal ones to the first source.
    """
    usable = [(s, max(0.0, w or 0.0), n * max(0, r or 0), n) for s, w, r, n in sources]
    wanted = sum(n for _, w, most, n in usable if w > 0 and most > 0) if total is None else total
    drawn = {s: 0.0 for s, *_ in usable}
    open_ = [x for x in usable if x[1] > 0 and x[2] > 0]
    left = float(wanted)
    while open_ and left > 1e-9:
        weight = sum(w for _, w, _, _ in open_)
        full = [x for x in open_ if x[2] <= left * x[1] / weight]
        if not full:
            for s, w, _, _ in open_:
                drawn[s] = left * w / weight
            break
        for s, _, most, _ in full:
            drawn[s] = float(most)
            left -= most
        open_ = [x for x in open_ if x not in full]
    whole = {s: math.floor(x + 1e-9) for s, x in drawn.items()}
    spare = round(sum(drawn.values())) - sum(whole.values())
    for s in sorted(drawn, key=lambda s: whole[s] - drawn[s])[: max(0, spare)]:
        whole[s] += 1
    return [Quota(s, w, n, most, min(whole[s], most)) for s, w, most, n in usable]


def draws(owed: Sequence[int], size: int, random: np.random.Generator) -> Iterator[np.ndarray]:
    """Counts of each source for one unit of `size` blocks after the other, until nothing is owed: multinomials over what is
    still owed, never above it."""
    left = np.array(owed, np.int64)
    while left.any():
        need = int(min(size, left.sum()))
        counts = np.zeros_like(left)
        while need:
            rest = left - counts
            counts += np.minimum(random.multinomial(need, rest / rest.sum()), rest)
            need = int(min(size, left.sum()) - counts.sum())
        left = left - counts
        yield counts


def group_draws(plan: Sequence[Quota], seed: int = 7) -> list[tuple[int, list[int], list[int]]]:
    """group, and for each source of the plan its first draw in that group and how many."""
    given = np.zeros(len(plan), np.int64)
    rows: list[tuple[int, list[int], list[int]]] = []
    for group, counts in enumerate(draws([q.drawn for q in plan], SHARD_BLOCKS * GROUP_SHARDS, np.random.default_rng(seed))):
        rows.append((group, given.tolist(), counts.tolist()))
        given = given + counts
    return rows


def shard_draws(group: int, first: Sequence[int], owed: Sequence[int], size: int, per_group: int, seed: int = 7) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source's place in the plan, first draw, draws) of the shards of a group, `per_group` shards of `size` blocks."""
    given = np.array(first, np.int64)
    for k, counts in enumerate(draws(owed, size, np.random.default_rng([seed, group]))):
        for source in np.flatnonzero(counts):
            yield group * per_group + k, int(source), int(given[source]), int(counts[source])
        given = given + counts


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(size), one for each key, at the given indexes: Feistel rounds with cycle walking."""
    value = index.astype(np.uint64)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    open_ = np.ones(len(value), bool)
    while open_.any():
        v, b, m, k = value[open_], bits[open_], mask[open_], key[open_].astype(np.uint64)
        left, right = v >> b, v & m
        for r in range(_ROUNDS):
            x = (right + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x >> np.uint64(32)) & m)
        value[open_] = left << b | right
        open_[open_] = value[open_] >= size[open_].astype(np.uint64)
    return value.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()))


def partition_places(encoded: DataFrame) -> DataFrame:
    """part, source, first and until: which of a source's tokens each partition holds. One short row for each pair."""
    totals = encoded.groupBy(F.spark_partition_id().alias("part"), "source").agg(F.sum("tokens").alias("n"))
    until = F.sum("n").over(Window.partitionBy("source").orderBy("part"))
    return totals.select("part", "source", (until - F.col("n")).alias("first"), until.alias("until"))


def packed(encoded: DataFrame, places: DataFrame) -> DataFrame:
    """source, block_no and ids (packed) of every block; each token of `encoded` is in exactly one block.

    `encoded` is a written table of source, tokens and ids, `places` what `partition_places` gives for it. A partition that
    holds another number of tokens than when it was counted ends the query with an error.
    """
    parts = OFFSET_PARTS
    laid = places.withColumn("folder", F.pmod("part", F.lit(parts))).repartition("folder").sortWithinPartitions("folder", "part")
    path = write_scratch(laid, "mix-places", ["folder"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        mine = scratch_rows(path, f"folder={part % parts}", "part", part).to_pylist()
        place = {r["source"]: r["first"] for r in mine}
        for batch in batches:
            sources: list[str] = []
            numbers: list[int] = []
            places: list[int] = []
            pieces: list[bytes] = []
            for source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, n, used = place[source], len(raw) // ID_BYTES, 0
                while used < n:
                    take = min(n - used, BLOCK_TOKENS - (at + used) % BLOCK_TOKENS)
                    sources.append(source)
                    numbers.append((at + used) // BLOCK_TOKENS)
                    places.append(at + used)
                    pieces.append(raw[used * ID_BYTES : (used + take) * ID_BYTES])
                    used += take
                place[source] = at + n
            columns = [pa.array(sources, pa.string()), pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["source", "block_no", "at", "part"])
        if place != {r["source"]: r["until"] for r in mine}:
            raise RuntimeError(f"partition {part} of the encoded documents has changed since it was counted")

    pieces = encoded.select("source", "ids").mapInArrow(run, "source string, block_no bigint, at bigint, part binary")
    whole = pieces.groupBy("source", "block_no").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda have, x: F.concat(have, x["part"]))
    return whole.select("source", "block_no", joined.alias("ids"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _unpacked(ids: pd.Series) -> pd.Series:
    return ids.map(lambda raw: np.frombuffer(raw, ID_TYPE).astype(np.int32))


def slots(spark: SparkSession, plan: Sequence[Quota], seed: int = 7) -> DataFrame:
    """shard, slot, source, repeat_no and block_no of every place of the mix."""
    size, per_group = SHARD_BLOCKS, GROUP_SHARDS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, first, owed in zip(frame["group"], frame["first"], frame["owed"]):
                rows = list(shard_draws(int(group), first, owed, size, per_group, seed))
                yield pd.DataFrame(rows, columns=["shard", "place", "first", "draws"])

    groups = spark.createDataFrame(group_draws(plan, seed), "group bigint, first array<bigint>, owed array<bigint>")
    drawn = groups.mapInPandas(run, "shard bigint, place int, first bigint, draws bigint").repartition("shard")
    blocks = spark.createDataFrame([(k, q.source, q.blocks) for k, q in enumerate(plan)], "place int, source string, blocks bigint")
    each = drawn.join(F.broadcast(blocks), "place").withColumn("j", F.explode(F.expr("sequence(first, first + draws - 1)")))
    repeat = F.expr("j div blocks")
    key = F.xxhash64("source", repeat, F.lit(seed))
    placed = each.select(
        "shard", "source", repeat.alias("repeat_no"), _permuted(F.expr("j % blocks"), F.col("blocks"), key).alias("block_no")
    )
    order = Window.partitionBy("shard").orderBy(F.xxhash64("source", "repeat_no", "block_no", F.lit(seed)), "source", "repeat_no", "block_no")
    return placed.withColumn("slot", F.row_number().over(order) - 1)


def plan_mix(tokens: dict[str, int], targets: DataFrame, total: int | None = None) -> list[Quota]:
    """Quotas from the tokens of each source and the table of source, target_share and max_repeats."""
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats"))
    rows = goal.orderBy("source").collect()  # one row for each target
    return quotas([(s, w, r, -(-tokens.get(s, 0) // BLOCK_TOKENS)) for s, w, r in rows], total)


def mix(encoded: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, slot, source, repeat_no, block_no, tokens) and its report, one row for each target.

    `encoded` is a written table of source, tokens and ids (packed). Sources without a target, and documents without a
    source or tokens, are in neither result. The report holds what the targets asked for, what was there, and the share of
    the mix's tokens that each source really has. Without any usable source the mix is empty and all shares are 0.
    """
    spark = encoded.sparkSession
    goals = targets.where("source is not null").select("source").distinct()
    used = encoded.join(F.broadcast(goals), "source", "left_semi").where("tokens > 0")
    places = written(partition_places(used), "mix-partitions")
    tokens = {r[0]: r[1] for r in places.groupBy("source").agg(F.max("until")).collect()}  # one row for each target
    plan = plan_mix(tokens, targets, total)
    placed = slots(spark, plan, seed)
    blocks = packed(used, places)
    joined = placed.join(blocks, ["source", "block_no"]).select(
        "shard", "slot", "source", "repeat_no", "block_no", _unpacked("ids").alias("tokens")
    )
    kinds = "source string, target_share double, blocks_held bigint, blocks_most bigint, tokens_held bigint"
    asked = spark.createDataFrame([(q.source, q.target_share, q.blocks, q.most, tokens.get(q.source, 0)) for q in plan], kinds)
    last = (F.col("block_no") + 1) * BLOCK_TOKENS > F.col("tokens_held")
    size = F.when(last, F.col("tokens_held") - F.col("block_no") * BLOCK_TOKENS).otherwise(BLOCK_TOKENS)
    got = placed.join(F.broadcast(asked.select("source", "tokens_held")), "source").groupBy("source").agg(
        F.sum(size).alias("tokens_drawn"), F.count("*").alias("blocks_drawn"), (F.max("repeat_no") + 1).alias("most_repeats")
    )
    report = asked.join(got, "source", "left").na.fill(0, ["tokens_drawn", "blocks_drawn", "most_repeats"])
    whole = report.agg(F.sum("tokens_drawn").alias("whole"))
    share = F.coalesce(F.try_divide(F.col("tokens_drawn").cast("double"), F.col("whole")), F.lit(0.0))
    return joined, report.join(F.broadcast(whole)).withColumn("actual_share", share).drop("whole")
