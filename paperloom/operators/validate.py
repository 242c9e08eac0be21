"""The rules that decide which documents and rows a person must look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DOC_DATE, DOC_ID, ITEM_BARCODE


def _issue(when: Column, code: str, severity: str, message: Column | str, field: str | None = None, row: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    number = F.lit(None).cast("int") if row is None else row.cast("int")
    body = F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        text.alias("message"),
        F.lit(field).cast("string").alias("field"),
        number.alias("row_number"),
    )
    return F.when(when, body)


def _issues(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def item_issues(resolved: DataFrame, flag_unconfirmed: bool = True) -> DataFrame:
    """Adds ``issues`` to resolved items."""
    row, sku, quantity = F.col("row_number"), F.col("sku"), F.col("quantity")
    missing, shaped, trusted = _empty("sku"), F.col("valid_shape"), F.col("trusted")
    issues = _issues(
        _issue(~F.coalesce(F.col("item_barcode").rlike(ITEM_BARCODE), F.lit(False)), "BARCODE_LENGTH", "error", F.concat(F.lit("item barcode is not 13 digits: "), F.coalesce("item_barcode", F.lit(""))), "itemBarcode", row),
        _issue(quantity.isNull(), "QTY_MISSING", "error", "quantity was not read", "quantity", row),
        _issue(quantity <= 0, "QTY_INVALID", "error", F.concat(F.lit("quantity is not a positive integer: "), quantity.cast("string")), "quantity", row),
        _issue(missing, "SKU_MISSING", "error", "SKU was not read", "sku", row),
        _issue(~missing & ~trusted & ~shaped, "SKU_MISSING", "warn", F.concat(F.lit("SKU has an unexpected shape: "), sku), "sku", row),
        _issue(~missing & ~trusted & shaped & F.lit(flag_unconfirmed), "SKU_UNCONFIRMED", "warn", F.concat(F.lit("SKU was read by OCR and is not confirmed: "), sku), "sku", row),
    )
    return resolved.withColumn("issues", issues)


def item_sums(items: DataFrame) -> DataFrame:
    """Per document: rows, sum of readable quantities, unreadable cells, rows with issues."""
    sums = [
        F.count(F.lit(1)).alias("n_items"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("sum_quantity"),
        F.count_if(F.col("quantity").isNull()).alias("n_unreadable"),
    ]
    if "issues" in items.columns:
        sums.append(F.count_if(F.size("issues") > 0).alias("n_items_with_issues"))
    return items.groupBy("batch_id", "doc_seq").agg(*sums)


def with_sums(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with the sums of their items; none gives zeros."""
    joined = documents.join(item_sums(items), ["batch_id", "doc_seq"], "left")
    names = ["n_items", "sum_quantity", "n_unreadable", *(["n_items_with_issues"] if "issues" in items.columns else [])]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in names})


def with_history(documents: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``is_duplicate``: the id is among those of previous runs.

    Repeats within the batch are not duplicates.
    """
    known = history.where("doc_id <> ''").select("doc_id").distinct().withColumn("is_duplicate", F.lit(True))
    return documents.join(known, "doc_id", "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def document_issues(documents: DataFrame) -> DataFrame:
    """Adds ``issues`` to documents with sums and history."""
    total, summed, unread = F.col("total_quantity"), F.col("sum_quantity"), F.col("n_unreadable")
    no_id, no_date = _empty("doc_id"), _empty("doc_date")
    mismatch = F.concat(
        F.lit("quantities add up to "), summed.cast("string"), F.lit(", the printed total is "), total.cast("string"),
        F.when(unread > 0, F.concat(F.lit("; unreadable cells: "), unread.cast("string"))).otherwise(""),
    )
    issues = _issues(
        _issue(no_id, "NO_DOC_BARCODE", "error", "document barcode was not found", "docId"),
        _issue(~no_id & ~F.col("doc_id").rlike(DOC_ID), "DOC_ID_FORMAT", "error", F.concat(F.lit("document id has a wrong format: "), F.col("doc_id")), "docId"),
        _issue(_empty("doc_number"), "DOC_NUMBER_MISSING", "error", "document number was not read", "docNumber"),
        _issue(F.coalesce("doc_id_mismatch", F.lit(False)), "DOC_ID_MISMATCH", "error", "barcode and printed number disagree", "docId"),
        _issue(no_date, "DOC_DATE_MISSING", "warn", "date was not read", "docDate"),
        _issue(~no_date & ~F.col("doc_date").rlike(DOC_DATE), "DOC_DATE_FORMAT", "warn", F.concat(F.lit("date has a wrong format: "), F.col("doc_date")), "docDate"),
        _issue(F.col("is_duplicate"), "DUPLICATE_DOC", "warn", F.concat(F.lit("document was processed before: "), F.col("doc_id")), "docId"),
        _issue(total.isNull(), "TOTALS_MISSING", "warn", "printed total was not read", "totals"),
        _issue(total != summed, "TOTAL_QTY_MISMATCH", "error", mismatch, "totals"),
        _issue(F.col("n_items") == 0, "ROW_COUNT_MISMATCH", "error", "document has no rows"),
    )
    checked = documents.withColumn("issues", issues)
    return checked.withColumn("has_error", F.exists("issues", lambda i: i["severity"] == "error"))


def validate(documents: DataFrame, resolved: DataFrame, history: DataFrame, flag_unconfirmed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, items) with their issues; items also get ``needs_review``.

    A row needs review for any issue of its own or any error of its document;
    warnings of the document do not flag its rows.
    """
    checked = check_documents(documents, resolved, history, flag_unconfirmed)
    return checked, flag_items(checked, resolved, flag_unconfirmed)


def check_documents(documents: DataFrame, resolved: DataFrame, history: DataFrame, flag_unconfirmed: bool = True) -> DataFrame:
    """Documents with the sums of their items, ``issues`` and ``has_error``."""
    return document_issues(with_history(with_sums(documents, item_issues(resolved, flag_unconfirmed)), history))


def flag_items(checked: DataFrame, resolved: DataFrame, flag_unconfirmed: bool = True) -> DataFrame:
    """Items with their ``issues`` and ``needs_review``; issues are composed after the items have moved."""
    verdicts = checked.select("batch_id", "doc_seq", "has_error")
    items = item_issues(resolved.join(verdicts, ["batch_id", "doc_seq"]), flag_unconfirmed)
    return items.withColumn("needs_review", (F.size("issues") > 0) | F.col("has_error")).drop("has_error")


def flagged_rows() -> Column:
    """How many rows of a checked document need review."""
    return F.when(F.col("has_error"), F.col("n_items")).otherwise(F.col("n_items_with_issues"))


def index_entries(documents: DataFrame, scanned_at: str) -> DataFrame:
    """Entries for the document index.

    ``flagged`` counts rows with issues and, if the document has an error, all
    rows again, so it can exceed ``rows``.
    """
    flagged = F.col("n_items_with_issues") + F.when(F.col("has_error"), F.col("n_items")).otherwise(0)
    return documents.select(
        F.col("doc_id").alias("docId"),
        F.col("doc_number").alias("docNumber"),
        F.col("doc_date").alias("docDate"),
        F.lit(scanned_at).alias("scannedAt"),
        F.col("n_items").cast("int").alias("rows"),
        (F.col("pdf_path") if "pdf_path" in documents.columns else F.lit(None).cast("string")).alias("pdfPath"),
        flagged.cast("int").alias("flagged"),
    )
