"""Messages delivered more than once: keep one delivery of each.

Only a 16-byte identity, the delivery order and the row's place in its file are shuffled.  The rows to drop become one
deletion vector for each file.  Vectors are laid out by file; a task that reads a file's wide payloads reads that file's
vector and skips its rows, so payloads are neither shuffled nor met by a broadcast, whatever the number of drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.ids import is_blank, stripped
from auditloom.session import scratch_rows, write_scratch

#: Parts into which deletion vectors are laid out by file.
VECTOR_PARTS = 256

# --- fixed values: subjects and the id part that the producer builds for them ---
SUBJECTS = {
    "audit.events.crawl_completed": "crawl_completed",
    "audit.events.score.computed": "score_computed",
    "audit.events.report.generated": "report_generated",
}
# ---------------------------------------------------------------------------------


def message_identity() -> Column:
    """Identity of a delivery: its msg_id without case and surrounding blanks, else the one the producer builds.

    Null, which means that nothing can be its copy, when there is neither: unknown subject, no audit_id, or a report without
    version.
    """
    given = F.when(~is_blank(F.col("msg_id")), F.lower(stripped(F.col("msg_id"))))
    kind = F.coalesce(*[F.when(F.col("subject") == s, F.lit(k)) for s, k in SUBJECTS.items()])
    version = F.concat(F.lit(":v"), F.get_json_object("payload", "$.version"))
    tail = F.when(kind == "report_generated", version).otherwise(F.lit(""))
    audit = F.when(~is_blank(F.col("audit_id")), F.lower(stripped(F.col("audit_id"))))
    return F.coalesce(given, F.concat(F.lit("audit:"), audit, F.lit(":"), kind, tail))


def _narrow(deliveries: DataFrame, identity: Column) -> DataFrame:
    return deliveries.select(
        F.unhex(F.md5(identity)).alias("identity"),
        F.col("received_at").isNull().alias("unknown_time"),
        "received_at",
        "delivery_no",
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def dropped_rows(deliveries: DataFrame, identity: Column | None = None) -> DataFrame:
    """file, row and delivery_no of every delivery but the first of its message.

    First is the least received_at (null after all others), then the least delivery_no, then the place in the files, so that
    exactly one row stays even if a whole row is repeated. `deliveries` must come from files. A hot identity is combined
    on the map side and never gathered.
    """
    rows = _narrow(deliveries, message_identity() if identity is None else identity).where("identity is not null")
    order = F.struct("unknown_time", "received_at", "delivery_no", "file", "row")
    kept = rows.groupBy("identity").agg(F.min(order).alias("first")).select("first.file", "first.row")
    return rows.select("file", "row", "delivery_no").join(kept, ["file", "row"], "left_anti")


def deletion_vectors(dropped: DataFrame) -> DataFrame:
    """file, rows: the positions to skip of each file, ascending; a vector is bounded by its file."""
    return dropped.groupBy("file").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def read_kept(spark: SparkSession, path: str, vectors: DataFrame) -> DataFrame:
    """All columns of the rows that stay. Nothing wide is shuffled; a task holds the vector of the file that it reads."""
    files = spark.read.parquet(path)
    names, parts = files.columns, VECTOR_PARTS
    placed = vectors.withColumn("part", F.pmod(F.col("file"), F.lit(parts))).repartition("part").sortWithinPartitions("part", "file")
    place = write_scratch(placed, "deletion-vectors", ["part"])
    held = spark.read.parquet(path).select(*names, F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            file, row = (batch.column(len(names) + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            keep = np.ones(batch.num_rows, bool)
            for f in np.unique(file):
                if f not in known:
                    known = {f: _vector(place, int(f), parts)}  # a task reads one file after the other
                mine = file == f
                keep[mine] = ~np.isin(row[mine], known[f])
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(keep))

    return held.mapInArrow(run, files.schema)


def _vector(place: str, file: int, parts: int) -> np.ndarray:
    """Positions to skip in a file; none for a file without drops."""
    found = scratch_rows(place, f"part={file % parts}", "file", file)
    return found["rows"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if found.num_rows else np.empty(0, np.int64)
