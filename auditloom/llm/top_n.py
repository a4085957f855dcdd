"""Top N rows of every group by simultaneous bisection.

Every row has an order-preserving code: a list of integers whose lexicographic order, greatest first, is the wanted
order (doubles by their bits, strings by their bytes, identifiers last, so that no two different rows tie).  All groups
refine their cutoff at once: a pass counts rows above the midpoints of each group's interval, keeps the part that holds
the N-th row and drops the rest, until each group's rows at or above its cutoff are exactly N.  Counting combines on the
map side.  Rows meet the state of their group by a broadcast where the groups are few; where they are many, by a shuffle in
which the rows of groups with very many are split over tasks.  So no large group is gathered, sorted or sent to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.hot import hot_keys, split_join
from auditloom.session import written

#: Parts into which a pass cuts each group's interval (midpoints + 1).
PARTS = 4096
#: Words of the code behind the current one whose bounds a pass takes along, to step over words that all rows share.
AHEAD = 3
#: Groups up to which their state is broadcast (some 150 bytes each).
MOST_BROADCAST_GROUPS = 50_000
_CHUNK = 7  # bytes of a string in one word


def _sortable(double: Column) -> Column:
    """A double's bits as a bigint of the same order; -0.0 counts as 0.0."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), double + F.lit(0.0))
    bits = bits.cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


class _Piece:
    """One ordering column as words: `words` of them, the k-th by `word(k)`."""

    def __init__(self, kind: str, column: str, descending: bool):
        self.kind, self.column, self.descending = kind, F.col(column), descending

    def prepared(self) -> Column:
        if self.kind == "double":
            least = F.lit(1 - 2**63 if self.descending else 2**63 - 2)
            value = F.when(F.isnan(self.column), least).when(self.column.isNotNull(), _sortable(self.column))
        elif self.kind == "string":
            return self.column
        else:
            value = self.column.cast("bigint")
        # NaN after all numbers and null after it, which are least in a code that is compared greatest first
        return F.coalesce(value if self.descending else F.bitwise_not(value), F.lit(-(2**63)))

    @property
    def words(self) -> Column:
        if self.kind != "string":
            return F.lit(2)
        return F.floor(F.coalesce(F.octet_length(self.column), F.lit(0)) / _CHUNK).cast("int") + 1

    def word(self, k: Column) -> Column:
        if self.kind != "string":
            return F.when(k == 0, F.shiftright(self.column, 32)).otherwise(self.column.bitwiseAND(F.lit(0xFFFFFFFF)))
        raw = F.encode(self.column, "utf-8")
        part = F.substring(raw, k * _CHUNK + 1, F.lit(_CHUNK))
        used = F.octet_length(part)
        padded = F.rpad(F.hex(part), 2 * _CHUNK, "0")
        value = F.conv(padded, 16, 10).cast("bigint") * 8 + used
        if not self.descending:
            value = F.lit(2**59) - value
        return F.coalesce(value, F.lit(-1).cast("bigint"))


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """`groups` and `order` columns of the first `n` distinct rows of each group.

    `order` lists (column, descending) and should end with an identifier. In every column NaN comes after all numbers and
    null last; strings are ordered by their bytes. Rows that agree in all these columns count once. Groups may be null and hold fewer than
    `n` rows; then all come out. An empty table gives an empty result; other columns are ignored.
    """
    types = dict(df.dtypes)
    kinds = ["double" if types[c] in ("double", "float") else "string" if types[c] == "string" else "bigint" for c, _ in order]
    raw = [_Piece(kind, c, d) for kind, (c, d) in zip(kinds, order)]
    names = [f"__o{k}" for k in range(len(order))]
    pieces = [_Piece(kind, name, d) for kind, name, (_, d) in zip(kinds, names, order)]
    group = F.struct(*[F.col(c) for c in groups])
    rows = df.select(
        F.md5(F.to_json(group, {"ignoreNullFields": "false"})).alias("__g"),
        *groups,
        *[c for c, _ in order],
        *[p.prepared().alias(name) for p, name in zip(raw, names) if p.kind != "string"],
        *[F.col(c).alias(name) for p, name, (c, _) in zip(raw, names, order) if p.kind == "string"],
    ).distinct()
    rows = written(rows, "top-n-rows")

    def word(level: Column) -> Column:
        offset: Column = F.lit(0)
        cases = []
        for p in pieces:
            cases.append((level < offset + p.words, p.word(level - offset)))
            offset = offset + p.words
        found = F.lit(0).cast("bigint")
        for condition, value in reversed(cases):
            found = F.when(condition, value).otherwise(found)
        return found

    def bounds(level: Column) -> list[Column]:
        ends = [F.count("*").alias("n")]
        for k in range(AHEAD + 1):
            ends += [F.min(word(level + k)).alias(f"lo{k}"), F.max(word(level + k)).alias(f"hi{k}")]
        return ends

    sizes = rows.groupBy("__g").agg(*bounds(F.lit(0)))
    start = written(sizes.where(F.col("n") > n), "top-n-groups")
    hot = written(hot_keys(start, "__g"), "top-n-hot")
    spread = F.struct(*names)

    def meet(left: DataFrame, right: DataFrame, groups_: int, how: str = "inner") -> DataFrame:
        if groups_ <= MOST_BROADCAST_GROUPS:
            return left.join(F.broadcast(right), "__g", how)
        return split_join(left, right, "__g", hot, spread, how)

    state = written(_advance(start.select("*", F.lit(n).alias("need"), F.lit(0).alias("level"), _no_prefix())), "top-n-state")
    done = state.where("decided")
    open_ = state.where("not decided")
    active = rows
    while (left := open_.count()) > 0:
        cut = open_.select("__g", "level", "lo", "hi", "need", "prefix", "check_level", "check_lo", "check_hi")
        seen = word(F.col("check_level"))
        inside = meet(active, cut, left).where((seen >= F.col("check_lo")) & (seen <= F.col("check_hi")))
        active = written(inside, "top-n-active")
        part = F.expr(f"(__w - lo) div ((hi - lo) div {PARTS} + 1)")
        counted = (
            active.withColumn("__w", word(F.col("level")))
            .withColumn("part", part)
            .groupBy("__g", "level", "need", "prefix", "part")
            .agg(*bounds(F.col("level")))
        )
        # PARTS rows of a group at most
        above = F.coalesce(
            F.sum("n").over(Window.partitionBy("__g").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        )
        chosen = (
            counted.withColumn("above", above)
            .where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
            .withColumn("need", F.col("need") - F.col("above"))
            .drop("part", "above")
        )
        active = active.select(*rows.columns)
        state = written(_advance(chosen), "top-n-state")
        done = done.unionByName(state.where("decided"))
        open_ = state.where("not decided")
    cutoffs = written(done.select("__g", "cutoff"), "top-n-cutoffs")
    code = F.transform(F.sequence(F.lit(0), F.size("cutoff") - 1), lambda k: word(k))
    joined = meet(rows, cutoffs, cutoffs.count(), "left")
    return joined.where(F.col("cutoff").isNull() | (code >= F.col("cutoff"))).select(*groups, *[c for c, _ in order])


def _no_prefix() -> Column:
    return F.array().cast("array<bigint>").alias("prefix")


def _advance(chosen: DataFrame) -> DataFrame:
    """State after a pass, from the part of each group that holds its N-th row.

    The part's rows are wanted whole: the group is decided. Words that they share join the prefix; the first that they do not
    share is refined between the part's least and greatest value.
    """
    whole = F.col("n") == F.col("need")
    # words in a row that all rows of the part share, and the first that they do not
    shared = F.lit(AHEAD)
    for k in reversed(range(AHEAD)):
        shared = F.when(F.col(f"lo{k}") != F.col(f"hi{k}"), F.lit(k)).otherwise(shared)
    los, his = (F.array(*[F.col(f"{end}{k}") for k in range(AHEAD + 1)]) for end in ("lo", "hi"))
    return chosen.select("*", shared.alias("shared"), los.alias("los"), his.alias("his")).select(
        "__g",
        "need",
        whole.alias("decided"),
        F.when(whole, F.array_append("prefix", F.col("lo0"))).alias("cutoff"),
        F.concat("prefix", F.slice("los", F.lit(1), F.col("shared"))).alias("prefix"),
        F.col("level").alias("check_level"),
        F.col("lo0").alias("check_lo"),
        F.col("hi0").alias("check_hi"),
        (F.col("level") + F.col("shared")).alias("level"),
        F.get("los", F.col("shared")).alias("lo"),
        F.get("his", F.col("shared")).alias("hi"),
    )
