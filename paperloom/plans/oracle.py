"""SQL oracles, written apart from the DataFrame plans.

Where a plan uses a running sum, the SQL uses a correlated maximum; where a
plan builds arrays of issues, the SQL is a union of one SELECT per rule.
"""

from __future__ import annotations

from .adapters import HISTORY_BEFORE, SCANNED_AT
from .queries import CODES, DECODED, HEADERS, PATHS

_SKU = (
    "upper(replace(p_brand, '#', '')) || '-' || upper(replace(p_type, ' ', '')) || '-' || "
    "CASE p_partkey % 3 WHEN 0 THEN 'АЛЫЙ' WHEN 1 THEN 'БЕЛЫЙ' ELSE 'СИНИЙ' END"
)
_VALID = r"regexp_full_match({0}, '[A-Za-z0-9]+-[A-Za-z0-9]+-[А-ЯЁа-яё]+(-(.|\n)*)?')"

ADAPTER = rf"""
parts AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS barcode, {_SKU} AS part_sku FROM part),
catalogue AS (SELECT barcode, part_sku AS sku FROM parts WHERE p_size < 40),
dictionary AS (
  SELECT barcode, 'OLD-' || part_sku AS sku, CASE WHEN p_type = 'PROMO' THEN 'confirmed' ELSE 'ocr' END AS source,
         CAST(1 AS BIGINT) AS seen, '2026-01-01T00:00:00.000Z' AS last_seen
  FROM parts WHERE p_size >= 40 AND p_type IN ('PROMO', 'ECONOMY')),
history AS (SELECT '15-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS doc_id FROM orders WHERE o_orderdate < TIMESTAMP '{HISTORY_BEFORE}'),
cells AS (
  SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn,
         lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS item_barcode,
         CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 7 = 0 THEN replace(part_sku, '-', '')
              ELSE part_sku || '-' || CAST(l_linenumber % 3 AS VARCHAR) || 'sm' END AS ocr_sku,
         CASE WHEN (l_partkey + l_suppkey) % 41 <> 0 THEN CAST(l_quantity AS BIGINT) END AS quantity,
         CAST(l_quantity AS BIGINT) AS true_quantity, l_suppkey AS price
  FROM lineitem LEFT JOIN parts ON l_partkey = p_partkey),
order_sums AS (SELECT o, count(*) AS n, sum(true_quantity) AS q, sum(price) AS s FROM cells GROUP BY o),
page_numbers AS (
  SELECT o_orderkey AS o, o_custkey AS c, o_orderdate, n, q, s, unnest(range(greatest((coalesce(n, 0) + 2) // 3, 1))) AS page_no
  FROM orders LEFT JOIN order_sums ON o_orderkey = o),
page_rows AS (
  SELECT *, CAST(c AS VARCHAR) AS batch_id,
    CAST((SELECT count(*) FROM page_numbers b WHERE b.c = a.c AND (b.o < a.o OR (b.o = a.o AND b.page_no < a.page_no))) AS INTEGER) AS page_index,
    page_no = 0 AND o % 11 <> 0 AS is_header,
    CASE WHEN page_no = greatest((coalesce(n, 0) + 2) // 3, 1) - 1 AND o % 19 <> 0 THEN coalesce(q, 0) + (o % 17 = 0)::INT END AS total_quantity,
    CASE WHEN page_no = greatest((coalesce(n, 0) + 2) // 3, 1) - 1 AND o % 29 <> 0 THEN s END AS total_sum
  FROM page_numbers a),
headers AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY page_index) AS doc_seq FROM page_rows WHERE is_header),
placed AS (
  SELECT p.*, coalesce(h.doc_seq, 0) AS doc_seq
  FROM page_rows p ASOF LEFT JOIN headers h ON p.batch_id = h.batch_id AND p.page_index >= h.page_index),
docs AS (
  SELECT h.batch_id, CAST(h.doc_seq AS BIGINT) AS doc_seq,
    CASE WHEN o % 23 <> 0 THEN '15-' || lpad(CAST(o AS VARCHAR), 10, '0') ELSE '' END AS doc_id,
    CASE WHEN o % 29 <> 0 THEN CAST(o AS VARCHAR) END AS doc_number,
    CASE WHEN o % 31 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS doc_date,
    o % 37 = 0 AS doc_id_mismatch, o_orderdate,
    CAST((SELECT arg_min(p.total_quantity, p.page_index) FROM placed p WHERE p.batch_id = h.batch_id AND p.doc_seq = h.doc_seq AND p.total_quantity IS NOT NULL) AS BIGINT) AS total_quantity,
    CAST((SELECT arg_min(p.total_sum, p.page_index) FROM placed p WHERE p.batch_id = h.batch_id AND p.doc_seq = h.doc_seq AND p.total_sum IS NOT NULL) AS BIGINT) AS total_sum,
    (SELECT count(*) FROM placed p WHERE p.batch_id = h.batch_id AND p.doc_seq = h.doc_seq) AS n_pages,
    h.page_index AS first_page
  FROM headers h),
item AS (
  SELECT batch_id, CAST(doc_seq AS BIGINT) AS doc_seq, page_index, item_barcode, ocr_sku, quantity,
    CAST(row_number() OVER (PARTITION BY batch_id, doc_seq ORDER BY page_index, rn) AS INTEGER) AS row_number
  FROM placed p JOIN cells c ON p.o = c.o AND p.page_no = (c.rn - 1) // 3 WHERE doc_seq > 0),
earlier AS (
  SELECT a.batch_id, a.doc_seq, a.row_number, b.ocr_sku AS earlier_sku
  FROM item a JOIN item b ON a.batch_id = b.batch_id AND a.item_barcode = b.item_barcode
    AND (b.doc_seq < a.doc_seq OR (b.doc_seq = a.doc_seq AND b.row_number < a.row_number)) AND {_VALID.format('b.ocr_sku')}
  QUALIFY row_number() OVER (PARTITION BY a.batch_id, a.doc_seq, a.row_number ORDER BY b.doc_seq DESC, b.row_number DESC) = 1),
resolved AS (
  SELECT *, sku_source IN ('catalogue', 'confirmed') AS trusted, coalesce({_VALID.format('sku')}, false) AS valid_shape
  FROM (
    SELECT i.*,
      CASE WHEN c.sku IS NOT NULL THEN c.sku WHEN d.source = 'confirmed' THEN d.sku ELSE coalesce(i.ocr_sku, e.earlier_sku, d.sku) END AS sku,
      CASE WHEN c.sku IS NOT NULL THEN 'catalogue' WHEN d.source = 'confirmed' THEN 'confirmed'
           WHEN coalesce(i.ocr_sku, e.earlier_sku, d.sku) IS NOT NULL THEN 'ocr' ELSE 'none' END AS sku_source
    FROM item i LEFT JOIN catalogue c ON c.barcode = i.item_barcode LEFT JOIN dictionary d ON d.barcode = i.item_barcode
      LEFT JOIN earlier e USING (batch_id, doc_seq, row_number))),
sums AS (
  SELECT batch_id, doc_seq, count(*) AS n_items, coalesce(sum(quantity), 0) AS sum_quantity, count(*) - count(quantity) AS n_unreadable
  FROM item GROUP BY ALL),
checked AS (
  SELECT d.*, coalesce(n_items, 0) AS n_items, coalesce(sum_quantity, 0) AS sum_quantity, coalesce(n_unreadable, 0) AS n_unreadable,
    d.doc_id IN (SELECT doc_id FROM history) AS is_duplicate
  FROM docs d LEFT JOIN sums USING (batch_id, doc_seq)),
item_issue AS (
  SELECT batch_id, doc_seq, row_number, 'QTY_MISSING' AS code, 'error' AS severity, 'quantity' AS field, 'quantity was not read' AS message FROM resolved WHERE quantity IS NULL
  UNION ALL SELECT batch_id, doc_seq, row_number, 'QTY_INVALID', 'error', 'quantity', 'quantity is not a positive integer: ' || quantity FROM resolved WHERE quantity <= 0
  UNION ALL SELECT batch_id, doc_seq, row_number, 'BARCODE_LENGTH', 'error', 'itemBarcode', 'item barcode is not 13 digits: ' || item_barcode FROM resolved WHERE length(item_barcode) <> 13
  UNION ALL SELECT batch_id, doc_seq, row_number, 'SKU_MISSING', 'error', 'sku', 'SKU was not read' FROM resolved WHERE sku IS NULL
  UNION ALL SELECT batch_id, doc_seq, row_number, 'SKU_MISSING', 'warn', 'sku', 'SKU has an unexpected shape: ' || sku FROM resolved WHERE NOT trusted AND NOT valid_shape AND sku IS NOT NULL
  UNION ALL SELECT batch_id, doc_seq, row_number, 'SKU_UNCONFIRMED', 'warn', 'sku', 'SKU was read by OCR and is not confirmed: ' || sku FROM resolved WHERE NOT trusted AND valid_shape),
doc_issue AS (
  SELECT batch_id, doc_seq, 'NO_DOC_BARCODE' AS code, 'error' AS severity, 'docId' AS field, 'document barcode was not found' AS message FROM checked WHERE doc_id = ''
  UNION ALL SELECT batch_id, doc_seq, 'DOC_ID_FORMAT', 'error', 'docId', 'document id has a wrong format: ' || doc_id FROM checked WHERE doc_id <> '' AND length(doc_id) <> 13
  UNION ALL SELECT batch_id, doc_seq, 'DOC_NUMBER_MISSING', 'error', 'docNumber', 'document number was not read' FROM checked WHERE doc_number IS NULL
  UNION ALL SELECT batch_id, doc_seq, 'DOC_ID_MISMATCH', 'error', 'docId', 'barcode and printed number disagree' FROM checked WHERE doc_id_mismatch
  UNION ALL SELECT batch_id, doc_seq, 'DOC_DATE_MISSING', 'warn', 'docDate', 'date was not read' FROM checked WHERE doc_date IS NULL
  UNION ALL SELECT batch_id, doc_seq, 'DUPLICATE_DOC', 'warn', 'docId', 'document was processed before: ' || doc_id FROM checked WHERE is_duplicate
  UNION ALL SELECT batch_id, doc_seq, 'TOTALS_MISSING', 'warn', 'totals', 'printed total was not read' FROM checked WHERE total_quantity IS NULL
  UNION ALL SELECT batch_id, doc_seq, 'TOTAL_QTY_MISMATCH', 'error', 'totals', 'quantities add up to ' || CAST(sum_quantity AS BIGINT) || ', the printed total is ' || total_quantity
      || CASE WHEN n_unreadable > 0 THEN '; unreadable cells: ' || n_unreadable ELSE '' END FROM checked WHERE total_quantity <> sum_quantity
  UNION ALL SELECT batch_id, doc_seq, 'ROW_COUNT_MISMATCH', 'error', NULL, 'document has no rows' FROM checked WHERE n_items = 0),
reviewed AS (
  SELECT r.*, EXISTS (SELECT 1 FROM item_issue i WHERE i.batch_id = r.batch_id AND i.doc_seq = r.doc_seq AND i.row_number = r.row_number)
    OR EXISTS (SELECT 1 FROM doc_issue i WHERE i.batch_id = r.batch_id AND i.doc_seq = r.doc_seq AND i.severity = 'error') AS needs_review
  FROM resolved r)
"""


#: With every part that the catalogue lacks in the dictionary.
WHOLE = ADAPTER.replace(" AND p_type IN ('PROMO', 'ECONOMY')", "").replace("WHEN p_type = 'PROMO'", "WHEN p_partkey % 8 = 0")


def over(sql: str, adapter: str = ADAPTER) -> str:
    return f"WITH {adapter} {sql}"


_READINGS = """
readings AS (
  SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS variant,
    CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(l_partkey % 3 AS VARCHAR) END AS text, l_tax * 100 AS confidence
  FROM lineitem),
counted AS (
  SELECT key, text, count(*) AS n, min(variant) AS first, max(confidence) AS confidence FROM readings WHERE text IS NOT NULL GROUP BY key, text),
winners AS (SELECT *, sum(n) OVER (PARTITION BY key) AS reads FROM counted QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, first) = 1)
"""
_RAW = """
raw AS (
  SELECT p_partkey AS pos, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_brand || '-' || p_type END AS sku,
    CASE WHEN p_partkey % 13 = 0 THEN 'x' || p_partkey ELSE lpad(CAST(p_partkey % 150 AS VARCHAR), 13, '0') END AS barcode FROM part),
good AS (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY pos) AS nth FROM raw WHERE regexp_full_match(barcode, '[0-9]{13}') AND trim(sku) <> ''),
winners AS (SELECT barcode, sku FROM good WHERE nth = 1)
"""
# text inputs of the scalar functions; the same strings as queries.FIELD_TEXT
FIELD_TEXT = """
fields AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS n, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%d') AS d, o_custkey AS c,
    CAST(o_custkey AS VARCHAR) AS cs FROM orders)
"""
_LONGEST = "list_reduce(list_prepend('', {0}), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"
_RUNS = "regexp_extract_all({0}, '[0-9]+')"
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_Q = "CASE c % 4 WHEN 0 THEN n || ' ' || cs WHEN 1 THEN 'ИЗВ ' || cs || ' 7' WHEN 2 THEN 'a' || n || 'b' || cs ELSE '-' END"
_T = "CASE c % 3 WHEN 0 THEN cs || ' ' || n || ' шт' WHEN 1 THEN p ELSE 'abc' END"
_N = "CASE c % 3 WHEN 0 THEN '№ 000' || n WHEN 1 THEN '000' ELSE 'x' END"
_D = (
    "CASE c % 5 WHEN 0 THEN d || ' 19:38:' WHEN 1 THEN replace(d, '-', ' ') || ' 1938' WHEN 2 THEN d || 'T09:05' "
    "WHEN 3 THEN replace(d, '-', '') ELSE p || d || '  07:' || lpad(CAST(c % 60 AS VARCHAR), 2, '0') END"
)
_S = (
    "CASE c % 5 WHEN 0 THEN 'AB' || n || '-CIF-' || chr(10) || 'АЛЫЙ' WHEN 1 THEN 'AB' || chr(10) || n WHEN 2 THEN 'AB' || chr(13) || chr(10) || '-C ' || n "
    "WHEN 3 THEN ' A ' || n || '-' || chr(10) || chr(10) || ' C' ELSE '  ' END"
)
_L = "CASE c % 4 WHEN 0 THEN 'A-B-' || n WHEN 1 THEN 'A-B' WHEN 2 THEN 'A-B-' || n || '-D' ELSE NULL END"
_C = "CASE k % 4 WHEN 0 THEN 'X-Y-З' WHEN 1 THEN 'X-Y-' WHEN 2 THEN 'X-Y-З-Q' ELSE NULL END"
_V = "CASE c % 6 WHEN 0 THEN 'A-B-Я-' || n WHEN 1 THEN 'A-B' WHEN 2 THEN 'A-B-' || n WHEN 3 THEN 'A--Я' WHEN 4 THEN p || '-Я' ELSE NULL END"
_H = (
    "CASE c % 4 WHEN 0 THEN '15-' || lpad(n, 10, '0') || chr(10) || cs || '77 ' || d || ' 9:38' WHEN 1 THEN '15-0000164 33 ' || n || '000 ' || d || ' 19:38:' "
    "WHEN 2 THEN 'tel 998' || lpad(n, 9, '0') || ' x ' || cs ELSE p || ' ' || n END"
)
_LINES = r"""list_filter(list_transform(regexp_split_to_array(raw, '\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"""

SQL: dict[str, str] = {
    "sheet_rows": over(
        """SELECT batch_id, doc_seq, row_number, coalesce(doc_number, '') AS doc_number, doc_id, coalesce(doc_date, '') AS doc_date, coalesce(sku, '') AS sku,
        item_barcode, quantity, CASE WHEN needs_review THEN '⚠' ELSE '' END AS flag FROM reviewed JOIN docs USING (batch_id, doc_seq)"""
    ),
    "log_rows": over(
        f"""SELECT batch_id, doc_seq, '{SCANNED_AT}' AS scanned_at, doc_id, coalesce(doc_number, '') AS doc_number, row_number, field, code, severity, message, '' AS pdf_path
        FROM (SELECT batch_id, doc_seq, '' AS row_number, coalesce(field, '') AS field, code, severity, message FROM doc_issue
              UNION ALL SELECT batch_id, doc_seq, CAST(row_number AS VARCHAR), field, code, severity, message FROM item_issue) JOIN docs USING (batch_id, doc_seq)"""
    ),
    "segment_documents": over(
        "SELECT batch_id, doc_seq, doc_id, doc_number, doc_date, doc_id_mismatch, n_pages, first_page FROM docs"
    ),
    "orphan_pages": over("SELECT batch_id, page_index FROM placed WHERE doc_seq = 0"),
    "totals_fallback": over("SELECT batch_id, doc_seq, total_quantity, total_sum FROM docs"),
    "row_numbers": over("SELECT batch_id, doc_seq, row_number, page_index, item_barcode, quantity FROM item"),
    "catalogue_lookup": over("SELECT i.batch_id, doc_seq, row_number, item_barcode, c.sku AS catalogue_sku FROM item i LEFT JOIN catalogue c ON barcode = item_barcode"),
    "catalogue_clean": f"WITH {_RAW} SELECT barcode, sku FROM winners",
    "catalogue_conflicts": f"""WITH {_RAW} SELECT pos, g.barcode, w.sku AS kept, g.sku AS refused FROM good g JOIN winners w USING (barcode)
        WHERE g.sku <> w.sku ORDER BY pos LIMIT 20""",
    "catalogue_report": f"""WITH {_RAW} SELECT (SELECT count(*) FROM raw) AS rows_read, (SELECT count(*) FROM raw) - (SELECT count(*) FROM good) AS skipped,
        (SELECT count(*) FROM winners) AS entries""",
    "sku_source_mix": over("SELECT sku_source, count(*) AS n_rows, count(DISTINCT item_barcode) AS n_barcodes FROM resolved GROUP BY ALL"),
    "sku_batch_fallback": over("SELECT batch_id, doc_seq, row_number, item_barcode, ocr_sku, sku, sku_source, trusted FROM resolved", WHOLE),
    "dictionary_merge": over(
        f"""SELECT barcode, CASE WHEN d.source = 'confirmed' THEN d.sku ELSE coalesce(u.sku, d.sku) END AS sku, coalesce(d.source, 'ocr') AS source,
        CAST(coalesce(d.seen, 0) + coalesce(u.n, 0) AS BIGINT) AS seen, CASE WHEN u.n IS NOT NULL THEN '{SCANNED_AT}' ELSE d.last_seen END AS last_seen
        FROM dictionary d FULL JOIN (
          SELECT barcode, sku, n FROM (SELECT item_barcode AS barcode, sku, count(*) OVER (PARTITION BY item_barcode) AS n,
            row_number() OVER (PARTITION BY item_barcode ORDER BY batch_id DESC, doc_seq DESC, row_number DESC) AS back
            FROM resolved WHERE sku_source = 'ocr' AND valid_shape) WHERE back = 1) u USING (barcode)""",
        WHOLE,
    ),
    "dictionary_confirm": """WITH d AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS barcode, p_brand AS sku, p_size FROM part)
        SELECT barcode, CASE WHEN p_size % 3 = 0 THEN 'NEW-' || sku ELSE sku END AS sku, CASE WHEN p_size % 3 = 0 THEN 'confirmed' ELSE 'ocr' END AS source,
        CAST(CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS seen FROM d""",
    "duplicate_docs": over("SELECT batch_id, doc_seq, doc_id FROM docs d WHERE EXISTS (SELECT 1 FROM history h WHERE h.doc_id = d.doc_id)"),
    "new_docs": over("SELECT batch_id, doc_seq, doc_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.doc_id = d.doc_id)"),
    "total_mismatch": over(
        """SELECT d.batch_id, d.doc_seq, any_value(d.total_quantity) AS total_quantity, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS sum_quantity
        FROM docs d LEFT JOIN item i USING (batch_id, doc_seq) GROUP BY d.batch_id, d.doc_seq HAVING any_value(d.total_quantity) <> coalesce(sum(quantity), 0)"""
    ),
    "unreadable_cells": over("SELECT batch_id, doc_seq, count(*) AS n_unreadable FROM item WHERE quantity IS NULL GROUP BY ALL"),
    "review_rate_by_month": over(
        """SELECT coalesce(strftime(o_orderdate, '%Y-%m'), '') AS month, count(*) AS n_rows, count(*) FILTER (needs_review) AS n_flagged
        FROM reviewed JOIN docs USING (batch_id, doc_seq) WHERE doc_date IS NOT NULL GROUP BY ALL"""
    ),
    "issue_histogram": over(
        """SELECT code, severity, count(*) AS n FROM (SELECT code, severity FROM doc_issue UNION ALL SELECT code, severity FROM item_issue) GROUP BY ALL"""
    ),
    "index_entries": over(
        f"""SELECT doc_id AS "docId", doc_number AS "docNumber", doc_date AS "docDate", '{SCANNED_AT}' AS "scannedAt", CAST(n_items AS INTEGER) AS "rows", CAST(NULL AS VARCHAR) AS "pdfPath",
        CAST((SELECT count(DISTINCT row_number) FROM item_issue i WHERE i.batch_id = c.batch_id AND i.doc_seq = c.doc_seq)
          + CASE WHEN EXISTS (SELECT 1 FROM doc_issue i WHERE i.batch_id = c.batch_id AND i.doc_seq = c.doc_seq AND severity = 'error') THEN n_items ELSE 0 END AS INTEGER) AS flagged
        FROM checked c"""
    ),
    "recent_index": over("SELECT doc_id, doc_number, doc_date FROM docs WHERE doc_date IS NOT NULL AND doc_id <> '' ORDER BY doc_date DESC, doc_id DESC LIMIT 20"),
    "run_summary": over(
        """SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM placed WHERE doc_seq = 0) AS orphan_pages,
        (SELECT count(*) FROM item) AS rows_appended, (SELECT count(*) FROM reviewed WHERE needs_review) AS flagged_rows,
        (SELECT count(DISTINCT item_barcode) FROM resolved WHERE trusted) AS sku_resolved, (SELECT count(*) FROM resolved WHERE sku_source = 'ocr') AS sku_from_ocr,
        (SELECT count(*) FROM catalogue) AS catalogue_entries""",
        WHOLE,
    ),
    "pdf_manifest": over(
        """SELECT batch_id, doc_seq, '2026-03-05/' || CASE WHEN doc_id <> '' THEN doc_id ELSE 'unknown_' || first_page END || '.pdf' AS pdf_path,
        (SELECT count(*) FROM placed p WHERE p.batch_id = d.batch_id AND p.doc_seq = d.doc_seq) AS n_pages FROM docs d"""
    ),
    "page_archive": over(
        "SELECT p.batch_id, CAST(p.doc_seq AS BIGINT) AS doc_seq, p.page_index, 'page_' || lpad(CAST(p.page_index AS VARCHAR), 3, '0') AS archive FROM placed p WHERE doc_seq > 0"
    ),
    "vote_field": f"WITH {_READINGS} SELECT key, nullif(text, '') AS text FROM winners",
    "vote_agreement": f"WITH {_READINGS} SELECT key, confidence, n / reads AS agreement FROM winners",
    "parse_quantity": f"""WITH {FIELD_TEXT}, r AS (SELECT k, {_LONGEST.format(_RUNS.format("regexp_replace(" + _Q + ", chr(92) || 's', '', 'g')"))} AS run FROM fields)
        SELECT k, CASE WHEN TRY_CAST(run AS BIGINT) > 0 THEN TRY_CAST(run AS BIGINT) END AS quantity FROM r""",
    "parse_total": f"WITH {FIELD_TEXT} SELECT k, TRY_CAST(nullif({_DIGITS.format(_T)}, '') AS BIGINT) AS total FROM fields",
    "parse_doc_number": f"""WITH {FIELD_TEXT}, r AS (SELECT k, {_DIGITS.format(_N)} AS digits FROM fields)
        SELECT k, CASE WHEN digits = '' THEN NULL WHEN ltrim(digits, '0') = '' THEN '0' ELSE ltrim(digits, '0') END AS doc_number FROM r""",
    "parse_doc_date": f"""WITH {FIELD_TEXT}, r AS (SELECT k, regexp_replace(trim(regexp_replace(regexp_replace({_D}, '[^0-9: -]', ' ', 'g'), ' +', ' ', 'g')), ':$', '') AS x FROM fields),
        q AS (SELECT k, x, {_DIGITS.format('x')} AS g FROM r)
        SELECT k, CASE WHEN regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}') THEN x
          WHEN length(g) >= 12 THEN g[1:4] || '-' || g[5:6] || '-' || g[7:8] || ' ' || g[9:10] || ':' || g[11:12] END AS doc_date FROM q""",
    "normalize_sku": f"""WITH {FIELD_TEXT}, r AS (SELECT k, {_S} AS raw FROM fields), l AS (SELECT k, {_LINES} AS lines FROM r)
        SELECT k, nullif(regexp_replace(list_reduce(list_prepend('', lines), lambda a, b: CASE WHEN a = '' OR ends_with(a, '-') OR starts_with(b, '-') THEN a || b ELSE a || '-' || b END), '\\s', '', 'g'), '') AS sku FROM l""",
    "merge_sku": f"""WITH {FIELD_TEXT}, r AS (SELECT k, {_L} AS a, {_C} AS b FROM fields)
        SELECT k, CASE WHEN a IS NULL THEN b
          WHEN b IS NOT NULL AND len(string_split(a, '-')) = len(string_split(b, '-')) AND len(string_split(a, '-')) >= 3 AND string_split(b, '-')[3] <> ''
          THEN array_to_string(list_concat(string_split(a, '-')[1:2], [string_split(b, '-')[3]], string_split(a, '-')[4:]), '-') ELSE a END AS sku FROM r""",
    "valid_sku": f"WITH {FIELD_TEXT}, r AS (SELECT k, {_V} AS s FROM fields) SELECT k, coalesce({_VALID.format('s')}, false) AS valid FROM r",
    "parse_header": rf"""WITH {FIELD_TEXT}, r AS (SELECT k, trim(regexp_replace(regexp_replace({_H}, '[\r\n]+', ' ', 'g'), '\s{{2,}}', ' ', 'g')) AS t FROM fields),
        i AS (SELECT k, t, regexp_extract(t, '\b([0-9]{{2}})[-\s]?([0-9]{{10}})\b') AS m, regexp_extract(t, '\b([0-9]{{2}})[-\s]?([0-9]{{10}})\b', 1) || '-' || regexp_extract(t, '\b([0-9]{{2}})[-\s]?([0-9]{{10}})\b', 2) AS id FROM r),
        u AS (SELECT k, m, id, CASE WHEN m = '' THEN t ELSE left(t, instr(t, m) - 1) || ' ' || substr(t, instr(t, m) + length(m)) END AS t FROM i),
        v AS (SELECT k, m, id, t, regexp_extract(t, '\b([0-9]{{4}})[-\s]([0-9]{{2}})[-\s]([0-9]{{2}})\s+([0-9]{{1,2}})[:\s]([0-9]{{2}})') AS dm,
          regexp_extract(t, '\b([0-9]{{4}})[-\s]([0-9]{{2}})[-\s]([0-9]{{2}})\s+([0-9]{{1,2}})[:\s]([0-9]{{2}})', ['y', 'mo', 'd', 'h', 'mi']) AS p FROM u),
        w AS (SELECT *, CASE WHEN dm = '' THEN t ELSE left(t, instr(t, dm) - 1) || ' ' || substr(t, instr(t, dm) + length(dm)) END AS rest FROM v)
        SELECT k, CASE WHEN m <> '' THEN id END AS doc_id, CASE WHEN dm <> '' THEN p.y || '-' || p.mo || '-' || p.d || ' ' || lpad(p.h, 2, '0') || ':' || p.mi END AS doc_date,
          nullif({_LONGEST.format("list_filter(" + _RUNS.format('rest') + ", lambda x: length(x) BETWEEN 4 AND 10 AND x[1] <> '0')")}, '') AS doc_number FROM w""",
    "doc_id_roundtrip": f"""WITH {FIELD_TEXT} SELECT k, '15-' || lpad(n, 10, '0') AS doc_id, n AS doc_number,
        CASE WHEN length(n || cs || '0000') <= 10 THEN '15-' || lpad(n || cs || '0000', 10, '0') END AS long_id FROM fields""",
    "session_batches": """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
        SELECT user_id, count(*) AS n_files, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""",
    "otsu_histogram": """WITH h AS (SELECT CAST(least(floor(value), 255) AS INTEGER) AS b, count(*) AS n FROM events WHERE value >= 0 GROUP BY ALL),
        c AS (SELECT a.b, sum(x.n) FILTER (x.b <= a.b) AS w0, sum(x.n) FILTER (x.b > a.b) AS w1, sum(x.n * x.b) FILTER (x.b <= a.b) AS s0, sum(x.n * x.b) FILTER (x.b > a.b) AS s1 FROM h a, h x GROUP BY a.b)
        SELECT CAST(arg_max(b, (CAST(w0 AS DOUBLE) * CAST(w1 AS DOUBLE) * (CAST(s0 AS DOUBLE) / w0 - CAST(s1 AS DOUBLE) / w1) * (CAST(s0 AS DOUBLE) / w0 - CAST(s1 AS DOUBLE) / w1)) - b * 1e-9) AS INTEGER) AS threshold FROM c WHERE w1 IS NOT NULL""",
    "peak_merge": """WITH p AS (SELECT DISTINCT user_id AS line, CAST(floor(epoch(ts)) AS BIGINT) // 600 AS y, CAST(round(value * 100) AS BIGINT) AS density FROM events),
        g AS (SELECT *, sum(opens) OVER (PARTITION BY line ORDER BY y, density ROWS UNBOUNDED PRECEDING) AS grp FROM (
          SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY line ORDER BY y, density) <= 3 THEN 0 ELSE 1 END AS opens FROM p))
        SELECT line, y, density FROM g QUALIFY row_number() OVER (PARTITION BY line, grp ORDER BY density DESC, y) = 1""",
    "longest_run": """WITH o AS (SELECT o_custkey AS page, o_orderkey AS band, o_orderstatus = 'F' AS usable FROM orders),
        g AS (SELECT page, band, usable, row_number() OVER (PARTITION BY page ORDER BY band) - row_number() OVER (PARTITION BY page, usable ORDER BY band) AS isle FROM o),
        r AS (SELECT page, min(band) AS first_band, count(*) AS n_bands FROM g WHERE usable GROUP BY page, isle)
        SELECT page, first_band, n_bands FROM r QUALIFY row_number() OVER (PARTITION BY page ORDER BY n_bands DESC, first_band) = 1""",
    "widest_column": """WITH e AS (SELECT l_orderkey AS page, list(DISTINCT l_partkey ORDER BY l_partkey) AS edges FROM lineitem GROUP BY ALL),
        w AS (SELECT page, list_transform(range(1, len(edges)), lambda i: edges[i + 1] - edges[i]) AS widths FROM e WHERE len(edges) >= 4),
        d AS (SELECT page, len(widths) AS n, list_position(widths, list_max(widths)) - 1 AS d FROM w)
        SELECT page, CAST(d AS INTEGER) AS description, CAST(CASE WHEN d + 1 < n THEN d + 1 END AS INTEGER) AS barcode, CAST(CASE WHEN d + 2 < n THEN d + 2 END AS INTEGER) AS price,
          CAST(CASE WHEN d + 3 < n THEN d + 3 END AS INTEGER) AS quantity, CAST(CASE WHEN d + 4 < n THEN d + 4 END AS INTEGER) AS "sum",
          CAST(CASE WHEN d >= 1 THEN d - 1 END AS INTEGER) AS sku, CAST(CASE WHEN d >= 2 THEN d - 2 END AS INTEGER) AS row_number FROM d WHERE d + 1 < n""",
    "upper_median": "SELECT l_orderkey AS page, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS median FROM lineitem GROUP BY ALL",
    "cell_boxes": """SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS a, l_suppkey AS b,
        CAST(l_partkey + 4 AS INTEGER) AS x, CAST(l_suppkey + 3 AS INTEGER) AS y, CAST(greatest(4, l_quantity + 30 - 8) AS INTEGER) AS width, CAST(greatest(4, l_linenumber * 2 - 6) AS INTEGER) AS height FROM lineitem""",
}

_ID_TEXT = r"\b([0-9]{2})[-\s]?([0-9]{10})\b"
_DATE_TEXT = r"\b([0-9]{4})[-\s]([0-9]{2})[-\s]([0-9]{2})\s+([0-9]{1,2})[:\s]([0-9]{2})"
_JOINED = "nullif(regexp_replace(list_reduce(list_prepend('', {0}), lambda a, b: CASE WHEN a = '' OR ends_with(a, '-') OR starts_with(b, '-') THEN a || b ELSE a || '-' || b END), '\\s', '', 'g'), '')"


def _elected(name: str, field: str) -> str:
    return f"""{name} AS (SELECT k, {field} AS x FROM (SELECT k, {field}, count(*) AS n, min(v) AS f FROM parsed WHERE {field} IS NOT NULL GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, f) = 1)"""


_CELLS = r"""
cells AS (
  SELECT row_number() OVER () AS id, l_orderkey AS k, l_linenumber AS line, lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS item_barcode,
    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, l_partkey AS p, l_suppkey AS s FROM lineitem),
texts AS (
  SELECT id, 1 AS v, q AS t FROM cells
  UNION ALL SELECT id, 2, CASE p % 3 WHEN 0 THEN '0' || q WHEN 1 THEN q || ' ' || q ELSE q END FROM cells
  UNION ALL SELECT id, 3, CASE s % 4 WHEN 0 THEN '0' || q ELSE '' END FROM cells WHERE s % 4 < 2),
voted AS (
  SELECT id, nullif(t, '') AS t, n / sum(n) OVER (PARTITION BY id) AS agreement FROM (SELECT id, t, count(*) AS n, min(v) AS f FROM texts GROUP BY id, t)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, f) = 1)
"""
_FAULTY = (
    ADAPTER.replace("\ndocs AS (", "\ndocs0 AS (")
    .replace(
        "\nitem AS (",
        """
docs AS (
  SELECT * REPLACE (CASE WHEN doc_seq % 6 = 5 AND doc_id <> '' THEN doc_id || '0' ELSE doc_id END AS doc_id,
    CASE WHEN doc_seq % 4 = 3 THEN replace(doc_date, '-', '/') ELSE doc_date END AS doc_date) FROM docs0),
item0 AS (""",
    )
    .replace(
        "\nearlier AS (",
        """
item AS (
  SELECT * REPLACE (CASE WHEN row_number % 5 = 4 THEN left(item_barcode, 12) ELSE item_barcode END AS item_barcode,
    CASE WHEN row_number % 7 = 3 THEN -quantity ELSE quantity END AS quantity) FROM item0),
earlier AS (""",
    )
)

SQL |= {
    "header_fields": rf"""WITH {FIELD_TEXT}, t AS (SELECT k, unnest([{', '.join(HEADERS)}]) AS raw, unnest([1, 2, 3, 4]) AS v, {DECODED} AS decoded FROM fields),
        r AS (SELECT k, v, trim(regexp_replace(regexp_replace(raw, '[\r\n]+', ' ', 'g'), '\s{{2,}}', ' ', 'g')) AS t FROM t),
        i AS (SELECT k, v, t, regexp_extract(t, '{_ID_TEXT}') AS m, regexp_extract(t, '{_ID_TEXT}', 1) || '-' || regexp_extract(t, '{_ID_TEXT}', 2) AS id FROM r),
        u AS (SELECT k, v, m, id, CASE WHEN m = '' THEN t ELSE left(t, instr(t, m) - 1) || ' ' || substr(t, instr(t, m) + length(m)) END AS t FROM i),
        d AS (SELECT *, regexp_extract(t, '{_DATE_TEXT}') AS dm, regexp_extract(t, '{_DATE_TEXT}', ['y', 'mo', 'd', 'h', 'mi']) AS p FROM u),
        w AS (SELECT *, CASE WHEN dm = '' THEN t ELSE left(t, instr(t, dm) - 1) || ' ' || substr(t, instr(t, dm) + length(dm)) END AS rest FROM d),
        parsed AS (SELECT k, v, CASE WHEN m <> '' THEN id END AS shown, CASE WHEN dm <> '' THEN p.y || '-' || p.mo || '-' || p.d || ' ' || lpad(p.h, 2, '0') || ':' || p.mi END AS date,
          nullif({_LONGEST.format("list_filter(" + _RUNS.format('rest') + ", lambda x: length(x) BETWEEN 4 AND 10 AND x[1] <> '0')")}, '') AS number FROM w),
        {_elected('a', 'number')}, {_elected('b', 'date')}, {_elected('c', 'shown')},
        e AS (SELECT f.k, t.decoded, a.x AS number, b.x AS date, c.x AS shown, '15-' || lpad(a.x, 10, '0') AS derived
          FROM fields f JOIN t ON t.k = f.k AND t.v = 1 LEFT JOIN a ON a.k = f.k LEFT JOIN b ON b.k = f.k LEFT JOIN c ON c.k = f.k),
        g AS (SELECT *, coalesce(decoded, derived, shown) AS doc_id FROM e)
        SELECT k, doc_id, coalesce(CASE WHEN ltrim(substr(doc_id, 4), '0') = '' THEN '0' ELSE ltrim(substr(doc_id, 4), '0') END, number) AS doc_number, date AS doc_date,
          decoded IS NOT NULL AS doc_id_from_barcode, coalesce(decoded <> derived, false) AS doc_id_mismatch FROM g""",
    "cell_readings": f"""WITH {_CELLS},
        skus AS (SELECT id, {_JOINED.format('a')} AS sku_latin, {_JOINED.format('b')} AS sku_cyrillic FROM (
          SELECT id, CASE WHEN s % 5 = 0 THEN NULL WHEN p % 2 = 0 THEN ['AB' || p || '-CIF-', 'ALYJ'] ELSE ['AB' || p || '-CIF-ALYJ - X'] END AS a,
            CASE p % 4 WHEN 0 THEN NULL WHEN 1 THEN ['Х-Х-АЛЫЙ-Х'] ELSE ['Х-Х-', 'АЛЫЙ'] END AS b FROM cells)),
        merged AS (SELECT *, string_split(sku_latin, '-') AS x, string_split(sku_cyrillic, '-') AS y FROM skus),
        read AS (SELECT id, t, agreement, TRY_CAST({_LONGEST.format(_RUNS.format("regexp_replace(t, chr(92) || 's', '', 'g')"))} AS BIGINT) AS number FROM voted)
        SELECT k, line, item_barcode, CASE WHEN sku_latin IS NULL THEN sku_cyrillic WHEN sku_cyrillic IS NOT NULL AND len(x) = len(y) AND len(x) >= 3 AND y[3] <> ''
          THEN array_to_string(list_concat(x[1:2], [y[3]], x[4:]), '-') ELSE sku_latin END AS sku, sku_latin, sku_cyrillic,
          CASE WHEN number > 0 THEN number END AS quantity, t AS quantity_raw, agreement AS quantity_agreement
        FROM cells JOIN merged USING (id) JOIN read USING (id)""",
    "printed_totals": f"""WITH {_CELLS} SELECT k, line, item_barcode, TRY_CAST(nullif({_DIGITS.format('t')}, '') AS BIGINT) AS total FROM cells JOIN voted USING (id)""",
    "column_probe": """WITH e AS (SELECT l_orderkey AS page, list(DISTINCT l_partkey ORDER BY l_partkey) AS edges FROM lineitem GROUP BY ALL),
        w AS (SELECT page, len(edges) - 1 AS n, list_transform(range(1, len(edges)), lambda i: edges[i + 1] - edges[i]) AS widths FROM e WHERE len(edges) >= 4),
        d AS (SELECT page, n, list_position(widths, list_max(widths)) AS named FROM w),
        c AS (SELECT page, n, named, unnest([0, 1, -1, 2, -2]) + named AS c, unnest([1, 2, 3, 4, 5]) AS rank FROM d WHERE named < n),
        b AS (SELECT page, any_value(n) AS n, coalesce(arg_min(c, rank) FILTER (c >= 0 AND c < n AND (page * 7 + c * 5) % 6 = 0), any_value(named)) AS b FROM c GROUP BY page)
        SELECT page, CAST(CASE WHEN b >= 3 THEN b - 3 END AS INTEGER) AS row_number, CAST(CASE WHEN b >= 2 THEN b - 2 END AS INTEGER) AS sku,
          CAST(CASE WHEN b >= 1 THEN b - 1 END AS INTEGER) AS description, CAST(b AS INTEGER) AS barcode, CAST(CASE WHEN b + 1 < n THEN b + 1 END AS INTEGER) AS price,
          CAST(CASE WHEN b + 2 < n THEN b + 2 END AS INTEGER) AS quantity, CAST(CASE WHEN b + 3 < n THEN b + 3 END AS INTEGER) AS "sum" FROM b""",
    "edge_similarity": """WITH e AS (SELECT l_orderkey AS page, list(DISTINCT l_partkey ORDER BY l_partkey) AS a FROM lineitem GROUP BY ALL),
        p AS (SELECT page, a, lead(a) OVER (PARTITION BY o_custkey ORDER BY page) AS b FROM e JOIN orders ON o_orderkey = page)
        SELECT page, len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(x - y) <= 20)) > 0)) / greatest(len(a), len(b)) AS similarity FROM p WHERE b IS NOT NULL""",
    "accepted_codes": f"""WITH {FIELD_TEXT}, r AS (SELECT k, {CODES} AS t FROM fields)
        SELECT k, CASE WHEN regexp_full_match(t, '[0-9]{{13}}') THEN t END AS barcode, CASE WHEN regexp_full_match(t, '[0-9]{{2}}-[0-9]{{10}}') THEN t END AS doc_id FROM r""",
    "network_paths": f"WITH {FIELD_TEXT}, r AS (SELECT k, {PATHS} AS t FROM fields) SELECT k, left(t, 2) IN ('//', repeat(chr(92), 2)) AS is_network FROM r",
    "stale_catalogues": f"""WITH {FIELD_TEXT} SELECT k, c % 5 = 0 OR c % 7 < 2 OR TIMESTAMP '1996-01-01 12:00:00' - (CAST(d AS TIMESTAMP) + INTERVAL 10 HOUR) > INTERVAL 8760 HOUR AS stale FROM fields""",
    "catalogue_zip": """WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name AS sku FROM part),
        b AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, CAST(c_custkey AS VARCHAR) AS barcode FROM customer) SELECT pos, sku, barcode FROM a JOIN b USING (pos)""",
    "rule_histogram": f"""WITH {_FAULTY} SELECT code, severity, coalesce(field, '') AS field, count(*) AS n FROM (
        SELECT code, severity, field FROM doc_issue UNION ALL SELECT code, severity, field FROM item_issue
        UNION ALL SELECT 'DOC_DATE_FORMAT', 'warn', 'docDate' FROM checked WHERE NOT regexp_full_match(doc_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}')) GROUP BY ALL""",
}
