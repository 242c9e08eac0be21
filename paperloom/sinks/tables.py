"""Append-only sheets and logs, and tables that are replaced as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOCUMENT_INDEX
from ..sources.tables import exists


def ensure_table(spark: SparkSession, path: str, schema: str) -> bool:
    """Creates an empty table with its header; False if it was there."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def append(rows: DataFrame, path: str, batch_key: str) -> None:
    """Appends the rows of one run exactly once.

    Each run writes its own partition, so a repeated run replaces what it wrote
    before instead of adding it again.
    """
    tagged = rows.withColumn("run", F.lit(batch_key))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def export_index(index: DataFrame, path: str) -> None:
    """The document index as JSON lines, which ``sources.read_index`` reads; a repeated export replaces it.

    Entries with an empty id are written too; readers skip them.
    """
    names = [f.split(" ")[0] for f in DOCUMENT_INDEX.split(", ")]
    index.select(*names).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def recover(spark: SparkSession, path: str) -> bool:
    """Puts the old table back if a swap was cut off between its renames."""
    at, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(at) and fs.exists(old) and fs.rename(old, at)


def replace(table: DataFrame, path: str) -> None:
    """Writes beside the old table, then swaps by renames; see ``recover``."""
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    table.write.parquet(new)
    recover(spark, path)
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old)]
    fs = at[0].getFileSystem(conf)
    fs.delete(at[2], True)
    if fs.exists(at[0]):
        fs.rename(at[0], at[2])
    if not fs.rename(at[1], at[0]):
        raise OSError(f"could not move {new} to {path}")
    fs.delete(at[2], True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def save_map(table: DataFrame, path: str, **header: str) -> None:
    """A small table ``(barcode, sku)`` as one JSON map with sorted keys."""
    rows = {r["barcode"]: r["sku"] for r in table.orderBy("barcode").toLocalIterator()}
    text = json.dumps({**header, "entries": rows}, ensure_ascii=False, sort_keys=True)
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, final = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.tmp", path))
    fs = final.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(final, False)
    fs.rename(new, final)


def truncate(spark: SparkSession, path: str) -> None:
    """Keeps the header (schema), drops all rows."""
    schema = spark.read.parquet(path).schema
    replace(spark.createDataFrame([], schema), path)


def head(spark: SparkSession, path: str, n: int = 8) -> tuple[list, int]:
    """The first rows and the number of all rows."""
    table = spark.read.parquet(path)
    return table.limit(n).collect(), table.count()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that executors share, removed when the driver ends.

    The folder is the one that ``spark.checkpoint.dir`` names; a local one is taken
    only where that is unset and the master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(named or 'file:///tmp/checkpoints').rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def stored(table: DataFrame, path: str, *more: DataFrame) -> DataFrame:
    """Writes a step of a query and reads it, so that it is computed once; its shuffle files go when it is written.

    ``more``: further parts of the step, each written when the one before it is.
    """
    spark = table.sparkSession
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        for part in (table, *more):
            part.write.mode("append").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(table.schema).parquet(path)
