"""Stored tables: JSON maps keyed by barcode and the JSON-lines index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.catalogue import zip_columns
from ..schemas import DOCUMENT_INDEX, SKU_CATALOGUE, SKU_DICTIONARY
from ..streaming.batches import IMAGE_FILES


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A multi-line JSON document; None if missing, an error if corrupt."""
    if not exists(spark, path):
        return None
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """barcode, sku of ``{"entries": {barcode: sku}}``; empty SKUs are dropped."""
    file = _json(spark, path, "syncedAt STRING, source STRING, entries MAP<STRING, STRING>")
    if file is None:
        return spark.createDataFrame([], SKU_CATALOGUE)
    return file.select(F.explode("entries").alias("barcode", "sku")).where(F.coalesce("sku", F.lit("")) != "")


def catalogue_synced_at(spark: SparkSession, path: str) -> str | None:
    file = _json(spark, path, "syncedAt STRING")
    row = file.first() if file is not None else None
    return row["syncedAt"] if row else None


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """barcode, sku, source, seen, last_seen; entries without a SKU are dropped."""
    entry = "STRUCT<sku: STRING, source: STRING, seen: BIGINT, lastSeen: STRING>"
    file = _json(spark, path, f"entries MAP<STRING, {entry}>")
    if file is None:
        return spark.createDataFrame([], SKU_DICTIONARY)
    rows = file.select(F.explode("entries").alias("barcode", "e")).where("e.sku is not null")
    return rows.select("barcode", "e.sku", "e.source", "e.seen", F.col("e.lastSeen").alias("last_seen"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The document index; blank and corrupt lines and empty ids are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], DOCUMENT_INDEX)
    lines = spark.read.text(path).select(F.from_json("value", DOCUMENT_INDEX).alias("e"))
    return lines.select("e.*").where("docId <> ''")


def list_images(spark: SparkSession, path: str, batch_id: str = "") -> DataFrame:
    """Image files of a folder or one file: batch_id, page_index, path, content.

    Pages are numbered in binary order of their paths.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(IMAGE_FILES))
    # numbering needs paths only: contents join back by path
    order = F.row_number().over(Window.partitionBy("batch_id").orderBy("path"))
    numbered = files.select("path").withColumn("batch_id", F.lit(batch_id)).withColumn("page_index", order - 1)
    return numbered.join(files.select("path", "content"), "path").select("batch_id", "page_index", "path", "content")


def with_positions(table: DataFrame) -> DataFrame:
    """Adds ``pos``, from 0: the place of each row in the files that the table was read from, in order of their paths.

    Rows are numbered within the blocks that tasks read, and blocks by a running
    sum over their sizes, of which there is one row a block; the rows themselves
    are never sorted, and no task sees more than its blocks.
    """
    block = ["_path", "_start"]
    seen = table.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    sizes = seen.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(*block, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = seen.join(F.broadcast(begins), block)
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop(*block, "_at", "_shift")


def read_columns(skus: DataFrame, sku: str, barcodes: DataFrame, barcode: str) -> DataFrame:
    """pos, sku, barcode of two columns that are kept apart, side by side to the shorter one.

    Only these columns are read; see ``with_positions`` for their rows' places.
    """
    left = with_positions(skus).select("pos", F.col(sku).cast("string").alias("value"))
    right = with_positions(barcodes).select("pos", F.col(barcode).cast("string").alias("value"))
    return zip_columns(left, right)


def read_two_columns(table: DataFrame, sku: str, barcode: str, position: str) -> DataFrame:
    """pos, sku, barcode of any tabular source; other columns are never read."""
    return table.select(F.col(position).cast("bigint").alias("pos"), F.col(sku).cast("string").alias("sku"), F.col(barcode).cast("string").alias("barcode"))
