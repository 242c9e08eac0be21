"""Which SKU a line item gets, and whether it is trusted.

Order of trust: catalogue, confirmed dictionary entry, the row's own OCR, the
latest valid OCR of an earlier row with the same barcode in the batch, the
dictionary's stored OCR.  The fourth stands for a dictionary that is updated
while rows are read; a window over the barcode gives it exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import valid_sku
from .catalogue import small


def lookup(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds ``catalogue_sku`` by a left join on the barcode."""
    right = small(catalogue.select(F.col("barcode").alias("item_barcode"), F.col("sku").alias("catalogue_sku")))
    return items.join(right, "item_barcode", "left")


def resolve(items: DataFrame, catalogue: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds sku (resolved), ocr_sku, sku_source, trusted, valid_shape."""
    known = small(
        dictionary.select(
            F.col("barcode").alias("item_barcode"), F.col("sku").alias("known_sku"), (F.col("source") == "confirmed").alias("is_confirmed")
        )
    )
    rows = lookup(items.withColumnRenamed("sku", "ocr_sku"), catalogue).join(known, "item_barcode", "left")
    in_catalogue = F.col("catalogue_sku").isNotNull()
    in_confirmed = ~in_catalogue & F.coalesce("is_confirmed", F.lit(False))
    own = _none_if_empty("ocr_sku")
    # only rows that fall through to OCR update what later rows see
    remembered = F.when(~in_catalogue & ~in_confirmed & valid_sku(own), own)
    earlier = (
        Window.partitionBy("batch_id", "item_barcode")
        .orderBy("doc_seq", "row_number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("earlier_sku", F.last(remembered, ignorenulls=True).over(earlier))
    sku = (
        F.when(in_catalogue, F.col("catalogue_sku"))
        .when(in_confirmed, F.col("known_sku"))
        .otherwise(F.coalesce(own, "earlier_sku", "known_sku"))
    )
    source = (
        F.when(in_catalogue, "catalogue")
        .when(in_confirmed, "confirmed")
        .when(F.coalesce(own, F.col("earlier_sku"), F.col("known_sku")).isNotNull(), "ocr")
        .otherwise("none")
    )
    return rows.select(
        "batch_id",
        "doc_seq",
        "row_number",
        "page_index",
        "item_barcode",
        "ocr_sku",
        sku.alias("sku"),
        source.alias("sku_source"),
        source.isin("catalogue", "confirmed").alias("trusted"),
        valid_sku(sku).alias("valid_shape"),
        "quantity",
        "quantity_raw",
    )


def _none_if_empty(name: str):
    return F.when(F.col(name) != "", F.col(name))


def source_mix(resolved: DataFrame) -> DataFrame:
    """Rows and distinct barcodes by source."""
    return resolved.groupBy("sku_source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("item_barcode").alias("n_barcodes")
    )
