"""Session, tables and scratch space."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyarrow.dataset import dataset, field
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators count on; a cluster's own values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("auditloom")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=conf | extra).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each application, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="auditloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(target)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's spark.checkpoint.dir. Only a session on one machine may do without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(?:\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = made = tempfile.mkdtemp(prefix="auditloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{_LOCAL_SCRATCH[app]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the scratch folder, read back: later stages restart from files, not from lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, name))


def written_parts(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """The rows of all frames, which have the same columns, as one written table. Each frame is a job of its own: as one plan
    the driver would plan all of them anew whenever a stage of any ends, and that takes memory."""
    paths = [write_scratch(df, name) for df in parts]
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*paths)


def write_scratch(df: DataFrame, name: str, by: Sequence[str] = ()) -> str:
    """Writes the frame into the scratch folder, laid out by the columns `by`; the table's path. It goes when Python ends."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    atexit.register(_forget, df.sparkSession, path)
    return path


def scratch_rows(path: str, part: str, column: str, value: int) -> pa.Table:
    """Rows of a scratch table, laid out by `part` (name=value), that have `value` in `column`; for use in tasks."""
    system, root = FileSystem.from_uri(path if "://" in path else f"file://{path}")
    folder = f"{root}/{part}"
    if system.get_file_info(folder).type == FileType.NotFound:
        return pa.table({})
    return dataset(folder, filesystem=system, format="parquet").to_table(filter=field(column) == value)


def _forget(spark: SparkSession, path: str) -> None:
    local = path.removeprefix("file://")
    if os.path.isabs(local):
        shutil.rmtree(local, ignore_errors=True)
        return
    try:  # a shared store is reached through Spark, if that still runs
        jvm, conf = spark._jvm, spark._jsparkSession.sparkContext().hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    except Exception:  # noqa: BLE001 - at exit there is nobody to tell
        pass
