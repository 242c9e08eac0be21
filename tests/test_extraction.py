"""Drawn pages to records and on to documents, rows and issues."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.image import bmp, encode, engines, extract
from paperloom.operators import resolve, segment, validate
from paperloom.schemas import PAGE_EXTRACTION, SKU_CATALOGUE, SKU_DICTIONARY
from paperloom.sources import images

from . import drawn


def code(k):
    return f"{1000076316479 + 37 * k:013d}"


def rows(n, start=0, quantity=lambda k: k + 1):
    colours = list(drawn.COLOURS)
    return [(code(start + k), f"NOVYGOD-CIF{start + k:04d}-{colours[k % 3]}", quantity(k)) for k in range(n)]


def batch():
    """Four pages, three documents, 36 rows: one id faded, one page of blue handwriting, one single row."""
    first = rows(13, 0)
    second = rows(13, 13)
    q = sum(r[2] for r in first + second)
    return [
        drawn.page(first, 600, ("15-0000163307", "163307", "2026-03-05 19:38"), faded=True),
        drawn.page(second, 60, total=q, total_sum=5000),
        drawn.page(rows(9, 30), 600, ("15-1006739165", "1006739165", "2026-03-06 08:05"), total=44, blue=True),
        drawn.page(rows(1, 50), 600, ("15-0000153419", "153419", "2026-03-07 10:00"), total=1),
    ]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    pages = [(f"p{k}.bmp", "b", k, bytearray(bmp.encode_bmp(p))) for k, p in enumerate(batch())]
    files = spark.createDataFrame(pages, "path string, batch_id string, page_index int, content binary")
    path = str(tmp_path_factory.mktemp("records") / "r")
    extract.extract_pages(files, drawn.read).write.parquet(path)
    return spark.read.parquet(path)


def test_records_have_the_schema_of_page_records(spark, records):
    want = spark.createDataFrame([], PAGE_EXTRACTION).schema
    got = {f.name: f.dataType for f in records.schema}
    assert {f.name: f.dataType.simpleString() for f in want} == {n: t.simpleString() for n, t in got.items() if n != "error"}


def test_headers_rows_and_totals_are_read(records):
    got = records.orderBy("page_index").collect()
    assert [r.is_header_page for r in got] == [True, False, True, True]
    assert [r.doc_id for r in got] == ["15-0000163307", None, "15-1006739165", "15-0000153419"]
    assert [r.doc_number for r in got] == ["163307", None, "1006739165", "153419"]
    assert [r.doc_date for r in got] == ["2026-03-05 19:38", None, "2026-03-06 08:05", "2026-03-07 10:00"]
    assert [r.doc_id_from_barcode for r in got] == [False, False, True, True]  # the faded one comes from the number
    assert not any(r.doc_id_mismatch or r.header_evidence_missing for r in got)
    assert [len(r.rows) for r in got] == [13, 13, 9, 1]
    assert [(r.totals.quantity, r.totals.sum) for r in got] == [(None, None), (182, 5000), (44, None), (1, None)]
    for page, start in zip(got, (0, 13, 30, 50), strict=True):
        assert [r.item_barcode for r in page.rows] == [code(start + k) for k in range(len(page.rows))]
        assert [r.quantity for r in page.rows] == [k + 1 for k in range(len(page.rows))]
        assert all(r.quantity_agreement == 1.0 for r in page.rows)
        assert page.rows[0].sku == f"NOVYGOD-CIF{start:04d}-АЛЫЙ" and page.rows[0].sku_latin.endswith("-ALYJ")
        assert page.columns.barcode == 3 and page.columns.sku == 1 and page.columns.quantity == 5


def test_images_become_documents_rows_and_issues(spark, records):
    segmented = segment.segment_pages(extract.only_read(records))
    documents, items = segment.documents(segmented), segment.items(segmented)
    resolved = resolve.resolve(items, spark.createDataFrame([], SKU_CATALOGUE), spark.createDataFrame([], SKU_DICTIONARY))
    checked, flagged = validate.validate(documents, resolved, spark.createDataFrame([], "doc_id string"))
    found = {r.doc_id: r for r in checked.collect()}
    assert len(found) == 3 and flagged.count() == 36
    assert [i.code for i in found["15-0000163307"].issues] == [] and found["15-0000163307"].n_pages == 2
    mismatch = found["15-1006739165"]  # nine rows add up to 45, the page prints 44
    assert [i.code for i in mismatch.issues] == ["TOTAL_QTY_MISMATCH"] and mismatch.sum_quantity == 45
    assert {i.code for r in flagged.collect() for i in r.issues} == {"SKU_UNCONFIRMED"}


def one(spark, image, reader=drawn.read):
    files = spark.createDataFrame([("p.bmp", bytearray(bmp.encode_bmp(image)))], "path string, content binary")
    return extract.extract_pages(files, reader).first()


def test_a_low_table_without_evidence_is_no_header(spark):
    got = one(spark, drawn.page(rows(2), 600))
    assert got.grid_found and not got.is_header_page and got.header_evidence_missing
    assert got.doc_id is None and len(got.rows) == 2


def test_a_number_alone_is_no_evidence(spark):
    got = one(spark, drawn.page(rows(2), 600, (None, "58500", None)))
    assert not got.is_header_page and got.doc_id is None and got.doc_number is None


def test_barcode_and_number_that_disagree(spark):
    got = one(spark, drawn.page(rows(2), 600, ("15-0000163307", "163309", None)))
    assert got.is_header_page and got.doc_id == "15-0000163307" and got.doc_number == "163307" and got.doc_id_mismatch


def test_a_page_without_a_table_may_have_a_header(spark):
    got = one(spark, drawn.page([], 600, ("15-0000163307", None, "2026-03-05 19:38"), no_table=True))
    assert not got.grid_found and not got.is_header_page and got.doc_id == "15-0000163307" and got.rows == []


def test_columns_are_found_by_their_barcodes(spark):
    widths = [78, 760, 351, 422, 218, 157, 197]  # the SKU's column is the widest, not the description's
    got = one(spark, drawn.page(rows(6), 600, (None, "163307", "2026-03-05 19:38"), widths=widths))
    assert got.columns.barcode == 3 and got.columns.description == 2
    assert [r.item_barcode for r in got.rows] == [code(k) for k in range(6)] and got.rows[5].quantity == 6


def test_a_far_line_is_no_band_of_totals(spark):
    image = drawn.page(rows(3), 600, (None, None, "2026-03-05 19:38"), total=7)
    line = 600 + drawn.ROW * 4 + 66
    image[line - 1 : line + 2] = 255
    image[line + 199 : line + 202, drawn.LEFT : drawn.edges()[-1]] = 0
    assert one(spark, image).totals.quantity is None


def test_quantities_need_no_majority_of_equal_crops(spark):
    answers = {"digits": iter(["7", "1", "1"])}
    got = one(spark, drawn.page(rows(1), 600), lambda plane, mode: (next(answers[mode], "") if mode in answers else "", 1.0))
    assert got.rows[0].quantity == 1 and got.rows[0].quantity_agreement == pytest.approx(2 / 3)


class Fake:
    opened, closed = [], []

    def __init__(self, mode):
        Fake.opened.append(mode)

    def read(self, plane):
        return " 5 ", 50.0

    def close(self):
        Fake.closed.append(self)


def test_engines_open_once_a_mode_and_close():
    with engines.reading(engines.EngineFactory(Fake)) as read:
        assert [read(np.zeros((2, 2)), m) for m in ("digits", "digits", "latin")] == [("5", 50.0)] * 3
        assert [m.language for m in Fake.opened] == ["eng", "eng"] and not Fake.closed
    assert len(Fake.closed) == 2


def test_a_factory_serves_a_stage(spark):
    got = one(spark, drawn.page(rows(1), 600), engines.EngineFactory(Fake))
    assert got.rows[0].quantity == 5


def tiff(plane, dpi):
    """A grey TIFF of one strip."""
    import struct

    h, w = plane.shape
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8 + 2 + 12 * 11 + 4 + 8), (277, 3, 1), (278, 4, h), (279, 4, w * h), (282, 5, 8 + 2 + 12 * 11 + 4), (296, 3, 2)]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I" if k != 3 else "<HH", *((v,) if k != 3 else (v, 0))) for t, k, v in tags)
    return b"II*\0" + struct.pack("<I", 8) + body + struct.pack("<I", 0) + struct.pack("<II", dpi, 1) + plane.tobytes()


def test_formats_give_the_same_record_and_their_dpi(spark, tmp_path):
    image = drawn.page(rows(2), 600, ("15-0000163307", "163307", "2026-03-05 19:38"), total=3)
    folder = tmp_path / "scan1"
    folder.mkdir()
    (folder / "a.bmp").write_bytes(bmp.encode_bmp(image, 600))
    (folder / "b.PNG").write_bytes(encode.encode_png(image, 300))
    (folder / "c.tiff").write_bytes(tiff(image[..., 0], 200))
    (folder / "e.txt").write_bytes(b"x")
    java = spark._jvm.javax.imageio.ImageIO
    drawing = java.read(spark._jvm.java.io.File(str(folder / "b.PNG")))
    assert java.write(drawing, "jpg", spark._jvm.java.io.File(str(folder / "d.jpeg")))
    found = images.read_images(spark, str(folder))
    got = extract.extract_pages(found, drawn.read).orderBy("page_index").collect()
    assert [(r.batch_id, r.page_index, r.dpi, r.path.rsplit("/", 1)[1]) for r in got] == [("scan1", 0, 600, "a.bmp"), ("scan1", 1, 300, "b.PNG"), ("scan1", 2, 200, "c.tiff"), ("scan1", 3, None, "d.jpeg")]
    same = [r.asDict() for r in got]
    for r in same:
        for name in ("path", "page_index", "dpi"):
            r.pop(name)
    assert same[0] == same[1] == same[2] == same[3] and same[0]["doc_id"] == "15-0000163307"
    (folder / "e.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    with pytest.raises(Exception, match="not a readable image"):
        images.read_images(spark, str(folder)).select("path").collect()


def test_folders_are_batches(spark, tmp_path):
    for name in ("s1/b.png", "s1/a.png", "s2/a.png"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(encode.encode_png(np.full((20, 20), 255, np.uint8)))
    got = images.read_images(spark, str(tmp_path), recursive=True).select("batch_id", "page_index", F.substring_index("path", "/", -1).alias("f")).collect()
    assert sorted(tuple(r) for r in got) == [("s1", 0, "a.png"), ("s1", 1, "b.png"), ("s2", 0, "a.png")]


def test_dpi_of_headers():
    assert images.dpi_of(b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\x01\x01\x2c\x01\x2c\0\0") == 300
    assert images.dpi_of(b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\x02\x00\x64\x00\x64\0\0") == 254
    assert images.dpi_of(tiff(np.zeros((2, 2), np.uint8), 150)) == 150
    assert images.dpi_of(b"\x89PNG\r\n\x1a\n\0\0") is None is images.dpi_of(b"x") is images.dpi_of(b"II*\0")


def test_files_that_were_not_read_fail_the_job(spark):
    files = spark.createDataFrame([("x.webp", bytearray(b"RIFF"))], "path string, content binary")
    with pytest.raises(Exception, match="page was not read: x.webp"):
        extract.only_read(extract.extract_pages(files)).collect()
