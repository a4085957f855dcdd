"""Joins on keys that may be hot: a key that holds a large part of the rows is split over many tasks.

The side that is joined to the rows has one row for each key and knows how many rows the key has.  Keys above a bound are
few by construction: the bound is at least a thousandth of all rows.  Their rows get a salt, their side rows are repeated
for every salt, and all other keys are joined as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that count as hot, at most; the bound of what is broadcast about them.
MOST_HOT = 1000
#: Rows from which a key may be hot, and tasks over which a hot key is split.
LEAST_HOT, SALTS = 20_000, 64


def hot_keys(sizes: DataFrame, key: str, weight: str = "n") -> DataFrame:
    """key of the hot keys, MOST_HOT at most. `sizes` has one row for each key and its number of rows."""
    total = sizes.agg(F.sum(weight)).first()[0] or 0
    bound = max(LEAST_HOT, -(-total // MOST_HOT))
    return sizes.where(F.col(weight) >= bound).select(key)


def split_join(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined to `side` on `key` (inner, left, left_semi or left_anti), hot keys by salted parts.

    `hot` holds the hot keys (`hot_keys`), `spread` differs among the rows of one key. Null keys match nothing.
    """
    marked = F.broadcast(hot.select(key).withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.join(marked, key, "left").withColumn("__salt", salt).drop("__hot")
    repeated = side.join(marked, key, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")
