"""Writers that may run twice: partitions are replaced, never added to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces exactly the partitions that `df` has rows of; a repeated write leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def upserted(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of both with the greatest version of each key; of equal versions the change wins."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("__new"))
    return both.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place", "__new")


def read_audit(spark: SparkSession, path: str, audit_id: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows of one audit, in order; partition pruning where the table is laid out by audit."""
    rows = spark.read.parquet(path).where(F.col("audit_id") == audit_id)
    return rows.orderBy(*order) if order else rows
