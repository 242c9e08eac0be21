"""Relational operators: segmentation, resolution, rules, catalogue, layout."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import catalogue as cat
from paperloom.operators import layout, outputs, resolve, segment, validate

PAGE = (
    "batch_id string, page_index int, is_header_page boolean, doc_id string, doc_number string, doc_date string, doc_id_mismatch boolean, "
    "totals struct<quantity:bigint,sum:bigint>, rows array<struct<band_index:int,item_barcode:string,sku:string,quantity:bigint,quantity_raw:string>>"
)
ITEM = "batch_id string, doc_seq bigint, row_number int, page_index int, item_barcode string, sku string, quantity bigint, quantity_raw string"
BAR = "1000076316479"


def page(index, header, doc_id="15-0000163307", total=None, rows=(), number="163307", date="2026-03-05 19:38", mismatch=False, batch="b"):
    cells = [(k, b, s, q, str(q)) for k, (b, s, q) in enumerate(rows)]
    return (batch, index, header, doc_id, number, date, mismatch, (total, None), cells)


def test_segmentation_and_totals_fallback(spark):
    flags = [(False, None), (True, None), (False, 5), (False, 7), (True, 1), (False, 2)]
    pages = spark.createDataFrame([page(k, h, total=t, rows=[(BAR, "A-B-Я", 1)] * 2) for k, (h, t) in enumerate(flags)], PAGE)
    segmented = segment.segment_pages(pages)
    assert [r.page_index for r in segment.orphan_pages(segmented).collect()] == [0]
    documents = {r.doc_seq: (r.n_pages, r.total_quantity) for r in segment.documents(segmented).collect()}
    assert documents == {1: (3, 5), 2: (2, 1)}
    items = segment.items(segmented).orderBy("doc_seq", "row_number").collect()
    assert [(r.doc_seq, r.row_number, r.page_index) for r in items] == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 3), (1, 6, 3), (2, 1, 4), (2, 2, 4), (2, 3, 5), (2, 4, 5)]


def test_batches_are_segmented_apart(spark):
    one = [page(k, k % 2 == 0, batch=b) for b in "xy" for k in range(4)]
    segmented = segment.segment_pages(spark.createDataFrame(one, PAGE))
    assert segment.documents(segmented).count() == 4


def test_resolution_equals_a_mutable_dictionary(spark):
    rng = random.Random(1)
    bars = [f"{k:013d}" for k in range(31)]
    catalogue, known = {bars[0]: "CAT"}, {bars[1]: ("OLD", "confirmed"), bars[2]: ("SEEN-X-Я", "ocr")}
    rows, want, memory = [], [], dict(known)
    for k in range(3000):
        bar, ocr = rng.choice(bars), rng.choice([None, "A-B-Я", "A-C-Ю", "bad", "A-B-Я-1"])
        rows.append(("b", 1, k + 1, 0, bar, ocr, 1, "1"))
        if bar in catalogue:
            want.append(("CAT", "catalogue"))
            continue
        entry = memory.get(bar)
        if entry and entry[1] == "confirmed":
            want.append((entry[0], "confirmed"))
            continue
        sku = ocr or (entry[0] if entry else None)
        want.append((sku, "ocr" if sku else "none"))
        if sku and len(sku.split("-")) >= 3:
            memory[bar] = (sku, "ocr")
    frame = spark.createDataFrame([(b, s) for b, s in catalogue.items()], "barcode string, sku string")
    entries = spark.createDataFrame([(b, s, o, 1, "t") for b, (s, o) in known.items()], "barcode string, sku string, source string, seen bigint, last_seen string")
    resolved = resolve.resolve(spark.createDataFrame(rows, ITEM), frame, entries)
    got = [(r.sku, r.sku_source) for r in resolved.orderBy("row_number").collect()]
    assert got == want
    merged = {r.barcode: (r.sku, r.source, r.seen) for r in cat.merge_dictionary(entries, resolved, "now").collect()}
    assert {b: (s, o) for b, (s, o, _) in merged.items()} == memory
    seen = sum(s == "ocr" and len(k.split("-")) >= 3 for k, s in ((k or "", s) for k, s in want))
    assert sum(n for *_, n in merged.values()) == seen + len(known)


def run(spark, pages, history=()):
    segmented = segment.segment_pages(spark.createDataFrame(pages, PAGE))
    catalogue = spark.createDataFrame([(BAR, "CAT-A-Я")], "barcode string, sku string")
    dictionary = spark.createDataFrame([], "barcode string, sku string, source string, seen bigint, last_seen string")
    resolved = resolve.resolve(segment.items(segmented), catalogue, dictionary)
    return validate.validate(segment.documents(segmented), resolved, spark.createDataFrame([(h,) for h in history], "doc_id string"))


RULES = [
    (dict(doc_id=None), ["NO_DOC_BARCODE/error"]),
    (dict(doc_id="15-1"), ["DOC_ID_FORMAT/error"]),
    (dict(number=None), ["DOC_NUMBER_MISSING/error"]),
    (dict(mismatch=True), ["DOC_ID_MISMATCH/error"]),
    (dict(date=None), ["DOC_DATE_MISSING/warn"]),
    (dict(date="05.03.2026"), ["DOC_DATE_FORMAT/warn"]),
    (dict(total=None), ["TOTALS_MISSING/warn"]),
    (dict(total=3), ["TOTAL_QTY_MISMATCH/error"]),
    (dict(rows=[], total=0), ["ROW_COUNT_MISMATCH/error"]),
    (dict(), []),
]


@pytest.mark.parametrize("change, codes", RULES, ids=lambda x: str(x)[:30])
def test_document_rules(spark, change, codes):
    documents, items = run(spark, [page(0, True, **({"total": 4, "rows": [(BAR, None, 4)]} | change))])
    row = documents.first()
    assert [f"{i.code}/{i.severity}" for i in row.issues] == codes
    error = any(c.endswith("error") for c in codes)
    assert all(r.needs_review == error for r in items.collect())


def test_item_rules(spark):
    rows = [(BAR, None, 1), (BAR, None, None), (BAR, None, -2), ("12", "A-B-Я", 1), ("1" * 13, None, 1), ("2" * 13, "bad", 1), ("3" * 13, "A-B-Я", 1)]
    documents, items = run(spark, [page(0, True, rows=rows, total=2)])
    got = [[f"{i.code}/{i.severity}" for i in r.issues] for r in items.orderBy("row_number").collect()]
    assert got == [
        [],
        ["QTY_MISSING/error"],
        ["QTY_INVALID/error"],
        ["BARCODE_LENGTH/error", "SKU_UNCONFIRMED/warn"],
        ["SKU_MISSING/error"],
        ["SKU_MISSING/warn"],
        ["SKU_UNCONFIRMED/warn"],
    ]
    # the sum is checked although a cell is unreadable
    assert [i.code for i in documents.first().issues] == ["TOTAL_QTY_MISMATCH"]
    assert "unreadable cells: 1" in documents.first().issues[0].message
    entry = validate.index_entries(documents, "t").first()
    assert (entry["rows"], entry.flagged) == (7, 6 + 7)


def test_duplicates_count_previous_runs_only(spark):
    pages = [page(0, True, rows=[(BAR, None, 4)], total=4), page(1, True, rows=[(BAR, None, 4)], total=4)]
    documents, items = run(spark, pages)
    assert not any(r.issues for r in documents.collect())
    documents, items = run(spark, pages, ["15-0000163307"])
    assert all([i.code for i in r.issues] == ["DUPLICATE_DOC"] for r in documents.collect())
    assert not any(r.needs_review for r in items.collect())


def test_outputs(spark):
    documents, items = run(spark, [page(0, True, doc_id=None, rows=[], total=None), page(1, True, rows=[(BAR, None, None)], total=4)])
    sheet = outputs.sheet_rows(documents, items).collect()
    assert [(r.doc_number, r.sku, r.quantity, r.flag) for r in sheet] == [("163307", "CAT-A-Я", None, "⚠")]
    log = {(r.doc_seq, r.code, r.row_number) for r in outputs.log_rows(documents, items, "t").collect()}
    assert (1, "ROW_COUNT_MISMATCH", "") in log and (2, "QTY_MISSING", "1") in log


def test_catalogue_cleaning_and_conflicts(spark):
    raw = [(0, "A", "1" * 13), (1, "B", "1" * 13), (2, "A", "1" * 13), (3, " ", "2" * 13), (4, "C", "x"), (5, " D ", "3" * 13)]
    frame = spark.createDataFrame(raw + [(10 + k, f"N{k}", "3" * 13) for k in range(30)], "pos bigint, sku string, barcode string")
    cleaned = cat.clean(frame)
    assert {r.barcode[0]: r.sku for r in cat.first_wins(cleaned).collect()} == {"1": "A", "3": "D"}
    shown = cat.conflicts(cleaned).collect()
    assert len(shown) == 20 and (shown[0].pos, shown[0].kept, shown[0].refused) == (1, "A", "B")
    report = cat.read_report(frame).first()
    assert (report.rows_read, report.skipped, report.entries) == (36, 2, 2)
    pairs = cat.zip_columns(spark.createDataFrame([(0, "a"), (1, "b")], "pos int, value string"), spark.createDataFrame([(0, "x")], "pos int, value string"))
    assert [tuple(r) for r in pairs.collect()] == [(0, "a", "x")]


def test_columns(spark):
    rows = spark.createDataFrame([(0, [0, 78, 468, 1189, 1611, 1829, 1986, 2183]), (1, [0, 369, 1051, 1450, 1656, 1804, 1990]), (2, [0, 5, 9])], "k int, e array<int>")
    got = {r.k: r.c for r in rows.select("k", layout.resolve_columns(F.col("e")).alias("c")).collect()}
    assert (got[0].description, got[0].barcode, got[0].sku, got[0].row_number, got[0]["sum"]) == (2, 3, 1, 0, 6)
    assert (got[1].description, got[1].barcode, got[1].sku, got[1].row_number) == (1, 2, 0, None)
    assert got[2] is None
    shown = spark.range(1).select(layout.barcode_candidates(F.lit(3), F.lit(5)).alias("c"), layout.upper_median(F.array(*map(F.lit, [4, 1, 3, 2]))).alias("m"))
    assert (shown.first().c, shown.first().m) == ([3, 4, 2, 1], 3)
