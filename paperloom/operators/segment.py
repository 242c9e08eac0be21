"""Pages to documents: a header page opens one, later pages attach to it.

A batch is the unit of order.  One shuffle by batch serves the running count;
documents and items keep to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_pages(pages: DataFrame) -> DataFrame:
    """Adds ``doc_seq``: 1, 2, ... within a batch; 0 for pages before any header."""
    order = Window.partitionBy("batch_id").orderBy("page_index")
    opened = F.sum(F.when(F.col("is_header_page"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("doc_seq", opened)


def orphan_pages(segmented: DataFrame) -> DataFrame:
    return segmented.where("doc_seq = 0")


def _first(value: Column) -> Column:
    """The first non-null in page order."""
    return F.min_by(value, F.when(value.isNotNull(), F.col("page_index")))


def documents(segmented: DataFrame) -> DataFrame:
    """One row per document: the header's fields, totals by fallback."""
    header = F.when(F.col("is_header_page"), F.col("page_index"))
    fields = {
        c: F.min_by(F.struct(c), header)[c] for c in ("doc_id", "doc_number", "doc_date", "doc_id_mismatch")
    }
    return (
        segmented.where("doc_seq > 0")
        .groupBy("batch_id", "doc_seq")
        .agg(
            *[v.alias(k) for k, v in fields.items()],
            _first(F.col("totals.quantity")).alias("total_quantity"),
            _first(F.col("totals.sum")).alias("total_sum"),
            F.count(F.lit(1)).alias("n_pages"),
            F.min("page_index").alias("first_page"),
        )
        .withColumn("doc_id", F.coalesce("doc_id", F.lit("")))
    )


def numbered(segmented: DataFrame) -> DataFrame:
    """Adds ``rows_before``: the rows on earlier pages of the document."""
    earlier = Window.partitionBy("batch_id", "doc_seq").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.greatest(F.size("rows"), F.lit(0)), F.lit(0))
    return segmented.withColumn("rows_before", F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("int"))


def items(segmented: DataFrame) -> DataFrame:
    """Line items with row numbers 1..n across the pages of a document.

    Pages are numbered before their rows are taken apart, so rows need not move.
    """
    pages = (segmented if "rows_before" in segmented.columns else numbered(segmented)).where("doc_seq > 0")
    rows = pages.select("batch_id", "doc_seq", "page_index", "rows_before", F.posexplode("rows").alias("band", "row"))
    return rows.select(
        "batch_id",
        "doc_seq",
        (F.col("rows_before") + F.col("band") + 1).alias("row_number"),
        "page_index",
        "row.item_barcode",
        "row.sku",
        "row.quantity",
        "row.quantity_raw",
    )
