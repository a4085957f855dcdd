"""Gzipped HTML snapshots: files {audit}/{md5 of the address}.html.gz."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def storage_path(audit_id: Column, url: Column) -> Column:
    return F.concat(audit_id, F.lit("/"), F.md5(url), F.lit(".html.gz"))


def write_snapshots(pages: DataFrame, folder: str) -> int:
    """Writes html of every page that has any, each file whole or not at all; returns how many. `folder` is shared."""
    rows = pages.where("html is not null").select(storage_path(F.col("audit_id"), F.col("url")).alias("path"), F.col("html").cast("binary").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, html in zip(batch["path"], batch["html"]):
                target = os.path.join(folder, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as file:
                    file.write(gzip.compress(bytes(html), mtime=0))
                os.replace(part, target)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@F.pandas_udf(T.StringType())
def _unpacked(content: pd.Series) -> pd.Series:
    def one(raw: bytes) -> str | None:
        try:
            return gzip.decompress(raw).decode("utf-8", "replace")
        except (OSError, EOFError):
            return None

    return content.map(one)


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """storage_path and html of every snapshot; html is null if a file is no gzip."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html.gz").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("storage_path"), _unpacked("content").alias("html"))
