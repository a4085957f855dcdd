"""References to records that are missing, deleted or loaded later than the reference.

References are aggregated per table, key and period before anything is joined, so the map-side combine takes hot keys.
Keys that hold very many references are few by construction: their groups are checked against a broadcast of their
parents.  All other keys are checked by a shuffle join of their groups.  Only then are the records of bad groups found, of
heavy keys by a broadcast of their groups, of the others among what is left without the heavy keys; the rows, and the counts,
of both parts are united.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.ids import canonical_uuid, is_blank
from auditloom.operators.hot import hot_keys
from auditloom.session import written

#: Bad groups of other keys up to which they are broadcast (some 50 bytes each); more are joined by a shuffle.
MOST_BROADCAST_GROUPS = 100_000


@dataclass(frozen=True)
class Source:
    """One referring table: its name in the result, its id, the reference and the record's own time."""

    name: str
    frame: DataFrame
    record_id: str
    reference: str
    at: str


def parent_state(parents: DataFrame, key: str, version: str, deleted: str, loaded: str) -> DataFrame:
    """One row for each parent: `key`, `deleted` (its current row has a deletion time) and `first_loaded`.

    The current row has the greatest version; a null version is the least; of equal versions a deleted row wins. Rows whose
    key is no UUID are no parents.
    """
    rows = parents.select(
        canonical_uuid(F.col(key)).alias("key"), F.col(version).alias("v"), F.col(deleted).alias("d"), F.col(loaded).alias("l")
    ).where("key is not null")
    return rows.groupBy("key").agg(
        F.max(F.struct("v", "d"))["d"].isNotNull().alias("deleted"), F.min("l").alias("first_loaded")
    )


def _references(sources: Sequence[Source]) -> DataFrame:
    parts = []
    for s in sources:
        ref, at = F.col(s.reference), F.col(s.at)
        parts.append(
            s.frame.where(~is_blank(ref)).select(
                F.lit(s.name).alias("record_table"),
                F.col(s.record_id).alias("record_id"),
                canonical_uuid(ref).alias("key"),
                at.alias("at"),
                F.coalesce(F.year(at) * 12 + F.month(at), F.lit(0)).alias("month"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_GROUP = ["record_table", "key", "month"]


def _bad(groups: DataFrame) -> DataFrame:
    """Groups that hold an orphan, with their verdict; of a late parent's group some records may be in time."""
    verdict = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("deleted"), "deleted")
        .when(F.col("first_loaded") > F.col("first_at"), "late")
    )
    return groups.select(*_GROUP, verdict.alias("verdict"), "first_loaded").where("verdict is not null")


def orphan_parts(sources: Sequence[Source], state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orphans of heavy keys and of values that are no key, and orphans of all other keys; both may hold copies of a row."""
    refs = _references(sources)
    keyed = refs.where("key is not null")
    usage = written(keyed.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.min("at").alias("first_at")), "orphan-usage")
    parents = written(state.withColumn("known", F.lit(True)), "orphan-parents")
    heavy = written(hot_keys(usage.groupBy("key").agg(F.sum("n").alias("n")), "key"), "orphan-heavy")
    of_heavy = parents.join(F.broadcast(heavy), "key", "left_semi")  # MOST_HOT parents at most
    heavy_groups = usage.join(F.broadcast(heavy), "key", "left_semi").join(F.broadcast(of_heavy), "key", "left")
    light_groups = usage.join(F.broadcast(heavy), "key", "left_anti").join(parents, "key", "left")
    heavy_bad, light_bad = written(_bad(heavy_groups), "orphan-heavy-bad"), written(_bad(light_groups), "orphan-light-bad")

    def found(rows: DataFrame, verdict: Column) -> DataFrame:
        reason = F.when((verdict != "late") | (F.col("first_loaded") > F.col("at")), verdict)
        return rows.select("record_table", "record_id", _period(F.col("at")).alias("period_month"), reason.alias("reason")).where(
            "reason is not null"
        )

    # periods of MOST_HOT keys at most
    first = found(refs.join(F.broadcast(heavy_bad), _GROUP, "left"), F.when(F.col("key").isNull(), "missing").otherwise(F.col("verdict")))
    rest = keyed.join(F.broadcast(heavy), "key", "left_anti")
    few = light_bad.count() <= MOST_BROADCAST_GROUPS
    second = found(rest.join(F.broadcast(light_bad) if few else light_bad, _GROUP), F.col("verdict"))
    return first, second


def _period(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown"))


def orphan_records(sources: Sequence[Source], state: DataFrame) -> DataFrame:
    """record_table, record_id, period_month, reason of every reference without a valid parent, each record once.

    reason is the first that holds of `missing` (no such parent, also when the value is no UUID), `deleted` and `late` (the
    parent was first loaded after the record's own time). Null and blank references are none. A record without a time is in
    period `unknown` and never late; a parent without any load time makes nothing late.
    """
    first, second = orphan_parts(sources, state)
    return first.unionByName(second).distinct()


def orphan_counts(*parts: DataFrame) -> DataFrame:
    """Orphans per table, period and reason: the counts of each part of records, united. Copies of a record count once."""
    by = ["record_table", "period_month", "reason"]
    counts = [part.distinct().groupBy(*by).agg(F.count("*").alias("orphans")) for part in parts]
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*by).agg(F.sum("orphans").alias("orphans"))
