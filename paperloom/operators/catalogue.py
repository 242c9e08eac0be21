"""Reference catalogue and learned dictionary of SKUs by barcode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ITEM_BARCODE

#: The conflict report lists so many; the limit is part of the report.
CONFLICTS_SHOWN = 20
#: A dimension of at most so many rows and bytes is broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small(dimension: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast where a bounded count shows that the dimension is small.

    Beyond either bound the planner's own size estimate decides.
    """
    each = F.lit(0)
    for column in dimension.columns:
        each = each + F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0))
    found = dimension.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(each.cast("long")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(dimension) if found["rows"] <= rows and found["bytes"] <= size else dimension


def zip_columns(skus: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Two single columns ``(pos, value)`` side by side, to the shorter one."""
    left = skus.select("pos", F.col("value").alias("sku"))
    return left.join(barcodes.select("pos", F.col("value").alias("barcode")), "pos")


def clean(raw: DataFrame) -> DataFrame:
    """Rows of ``raw(pos, sku, barcode)`` with a 13-digit barcode and a SKU."""
    trimmed = raw.select("pos", F.trim("sku").alias("sku"), F.trim("barcode").alias("barcode"))
    return trimmed.where(F.col("barcode").rlike(ITEM_BARCODE) & (F.col("sku") != ""))


def first_wins(cleaned: DataFrame) -> DataFrame:
    """barcode, sku: the first row of each barcode (combines before shuffling)."""
    return cleaned.groupBy("barcode").agg(F.min_by("sku", "pos").alias("sku"))


def conflicts(cleaned: DataFrame, shown: int | None = CONFLICTS_SHOWN) -> DataFrame:
    """pos, barcode, kept, refused of later rows with another SKU, in order."""
    kept = first_wins(cleaned).withColumnRenamed("sku", "kept")
    rows = cleaned.join(kept, "barcode").where("sku <> kept").select("pos", "barcode", "kept", F.col("sku").alias("refused"))
    return rows.orderBy("pos").limit(shown) if shown is not None else rows


def read_report(raw: DataFrame) -> DataFrame:
    """rows_read, skipped, entries: what a catalogue fetch reports."""
    good = F.trim("barcode").rlike(ITEM_BARCODE) & (F.trim("sku") != "")
    return raw.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("skipped"),
        F.count_distinct(F.when(good, F.trim("barcode"))).alias("entries"),
    )


def merge_dictionary(dictionary: DataFrame, resolved: DataFrame, now: str) -> DataFrame:
    """The dictionary after a run: upserts each valid OCR suggestion.

    ``resolved``: items with sku_source, sku and valid_shape.  The last value
    in document order wins, ``seen`` grows by the rows, and confirmed entries
    keep their SKU.
    """
    seen = resolved.where("sku_source = 'ocr' and valid_shape").groupBy(F.col("item_barcode").alias("barcode"))
    order = F.struct("batch_id", "doc_seq", "row_number")
    new = seen.agg(F.max_by("sku", order).alias("new_sku"), F.count(F.lit(1)).alias("rows"))
    confirmed = F.col("source") == "confirmed"
    touched = F.col("rows").isNotNull()
    return dictionary.join(new, "barcode", "full_outer").select(
        "barcode",
        F.when(confirmed, F.col("sku")).otherwise(F.coalesce("new_sku", "sku")).alias("sku"),
        F.coalesce("source", F.lit("ocr")).alias("source"),
        (F.coalesce("seen", F.lit(0)) + F.coalesce("rows", F.lit(0))).cast("bigint").alias("seen"),
        F.when(touched, F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def confirm(dictionary: DataFrame, confirmations: DataFrame, now: str) -> DataFrame:
    """The dictionary after a person confirmed ``confirmations(barcode, sku)``."""
    new = confirmations.groupBy("barcode").agg(F.max("sku").alias("new_sku"), F.count(F.lit(1)).alias("rows"))
    return dictionary.join(new, "barcode", "full_outer").select(
        "barcode",
        F.coalesce("new_sku", "sku").alias("sku"),
        F.when(F.col("rows").isNotNull(), "confirmed").otherwise(F.col("source")).alias("source"),
        (F.coalesce("seen", F.lit(0)) + F.coalesce("rows", F.lit(0))).cast("bigint").alias("seen"),
        F.when(F.col("rows").isNotNull(), F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"),
    )
