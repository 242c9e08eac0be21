"""Projections for the sheets, the log and the run's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validate import flagged_rows

FLAG = "⚠"


def sheet_rows(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The main sheet: one row per item; nulls of text become ''."""
    heads = documents.select("batch_id", "doc_seq", "doc_number", "doc_id", "doc_date")
    rows = items.join(heads, ["batch_id", "doc_seq"])
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("doc_number", "doc_id", "doc_date", "sku", "item_barcode")]
    return rows.select("batch_id", "doc_seq", "row_number", *text, "quantity", F.when(F.col("needs_review"), FLAG).otherwise("").alias("flag"))


def log_rows(documents: DataFrame, items: DataFrame, scanned_at: str) -> DataFrame:
    """The log: issues of documents, also of those without items, and of items."""
    path = F.coalesce("pdf_path", F.lit("")) if "pdf_path" in documents.columns else F.lit("")
    head = ["batch_id", "doc_seq", "doc_id", F.coalesce("doc_number", F.lit("")).alias("doc_number"), path.alias("pdf_path")]
    of_documents = documents.select(*head, "issues")
    of_items = items.where(F.size("issues") > 0).join(documents.select(*head), ["batch_id", "doc_seq"]).select(*of_documents.columns)
    return of_documents.withColumn("i", F.explode("issues")).unionByName(of_items.withColumn("i", F.explode("issues"))).select(
        "batch_id",
        "doc_seq",
        F.lit(scanned_at).alias("scanned_at"),
        "doc_id",
        "doc_number",
        F.coalesce(F.col("i.row_number").cast("string"), F.lit("")).alias("row_number"),
        F.coalesce("i.field", F.lit("")).alias("field"),
        "i.code",
        "i.severity",
        "i.message",
        "pdf_path",
    )


def review_rates(documents: DataFrame) -> DataFrame:
    """Rows and flagged rows by month, of checked documents that have a date and rows."""
    months = documents.where("doc_date is not null and n_items > 0").groupBy(F.substring("doc_date", 1, 7).alias("month"))
    return months.agg(F.sum("n_items").alias("n_rows"), F.sum(flagged_rows()).alias("n_flagged"))


def run_summary(segmented: DataFrame, documents: DataFrame, items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row: documents, orphan pages, rows, flagged rows, SKU counters.

    Rows are counted in the checked documents, so items need not be joined with them.
    """
    pages = segmented.agg(F.count_if(F.col("doc_seq") == 0).alias("orphan_pages"))
    docs = documents.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("rows_appended"),
        F.coalesce(F.sum(flagged_rows()), F.lit(0)).alias("flagged_rows"),
    )
    rows = items.agg(
        F.count_distinct(F.when(F.col("trusted"), F.col("item_barcode"))).alias("sku_resolved"),
        F.count_if(F.col("sku_source") == "ocr").alias("sku_from_ocr"),
    )
    entries = catalogue.agg(F.count(F.lit(1)).alias("catalogue_entries"))
    # single rows each, whose columns fill up to one
    one = docs
    for other in (pages, rows, entries):
        one = one.unionByName(other, allowMissingColumns=True)
    order = ["documents", "orphan_pages", "rows_appended", "flagged_rows", "sku_resolved", "sku_from_ocr", "catalogue_entries"]
    return one.agg(*(F.max(c).alias(c) for c in order))


def pdf_manifest(segmented: DataFrame, documents: DataFrame, scan_date: str) -> DataFrame:
    """The PDF of each document: its path and pages in order."""
    pages = segmented.where("doc_seq > 0").groupBy("batch_id", "doc_seq").agg(F.sort_array(F.collect_list("page_index")).alias("pages"))
    name = F.when(F.col("doc_id") != "", F.col("doc_id")).otherwise(F.concat(F.lit("unknown_"), F.col("first_page").cast("string")))
    return documents.join(pages, ["batch_id", "doc_seq"]).select(
        "batch_id", "doc_seq", F.concat(F.lit(f"{scan_date}/"), name, F.lit(".pdf")).alias("pdf_path"), "pages"
    )
