"""Row schemas of the engine's tables, as Spark DDL."""

ISSUE = "STRUCT<code: STRING, severity: STRING, message: STRING, field: STRING, row_number: INT>"
EXTRACTED_ROW = (
    "STRUCT<band_index: INT, item_barcode: STRING, sku: STRING, sku_latin: STRING, sku_cyrillic: STRING, "
    "quantity: BIGINT, quantity_raw: STRING, quantity_agreement: DOUBLE>"
)
PAGE_EXTRACTION = (
    "batch_id STRING, page_index INT, path STRING, width INT, height INT, is_header_page BOOLEAN, skew_deg DOUBLE, "
    "doc_id STRING, doc_number STRING, doc_date STRING, doc_id_from_barcode BOOLEAN, doc_id_mismatch BOOLEAN, "
    "header_evidence_missing BOOLEAN, grid_found BOOLEAN, "
    "columns STRUCT<row_number: INT, sku: INT, description: INT, barcode: INT, price: INT, quantity: INT, sum: INT>, "
    f"rows ARRAY<{EXTRACTED_ROW}>, totals STRUCT<quantity: BIGINT, sum: BIGINT>"
)
DOCUMENT = (
    "batch_id STRING, doc_seq BIGINT, doc_id STRING, doc_number STRING, doc_date STRING, doc_id_mismatch BOOLEAN, "
    "total_quantity BIGINT, total_sum BIGINT, n_pages BIGINT, first_page INT"
)
ITEM = (
    "batch_id STRING, doc_seq BIGINT, row_number INT, page_index INT, item_barcode STRING, sku STRING, "
    "quantity BIGINT, quantity_raw STRING"
)
CATALOGUE_RAW = "pos BIGINT, sku STRING, barcode STRING"
SKU_CATALOGUE = "barcode STRING, sku STRING"
SKU_DICTIONARY = "barcode STRING, sku STRING, source STRING, seen BIGINT, last_seen STRING"
DOCUMENT_INDEX = "docId STRING, docNumber STRING, docDate STRING, scannedAt STRING, rows INT, pdfPath STRING, flagged INT"

#: Severity of every issue code; the last three are declared, never emitted.
ISSUE_CODES = {
    "NO_DOC_BARCODE": "error",
    "DOC_ID_FORMAT": "error",
    "DOC_NUMBER_MISSING": "error",
    "DOC_ID_MISMATCH": "error",
    "DOC_DATE_MISSING": "warn",
    "DOC_DATE_FORMAT": "warn",
    "DUPLICATE_DOC": "warn",
    "BARCODE_LENGTH": "error",
    "QTY_MISSING": "error",
    "QTY_INVALID": "error",
    "SKU_MISSING": "error",
    "SKU_UNCONFIRMED": "warn",
    "TOTALS_MISSING": "warn",
    "TOTAL_QTY_MISMATCH": "error",
    "ROW_COUNT_MISMATCH": "error",
    "DOC_NUMBER_MISMATCH": "error",
    "BARCODE_CHECKSUM": "warn",
    "COLUMN_DETECTION_FALLBACK": "warn",
}
