"""Page images to page records.

An Arrow stage turns each page into *readings*: geometry, decoded symbols and
what a reader saw in each crop at each threshold.  All that follows is column
expressions over those rows: parsing, voting, the id's order of trust, the
evidence of a header page, the two alphabets of a SKU and the printed totals.

Reading text needs an engine that is not part of this package: pass a function
``reader(plane, mode) -> (text, confidence)`` or an ``EngineFactory``; the
default reads nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as fields
from ..functions import voting
from ..operators.layout import COLUMN_STEPS, columns_around
from . import kernels as K
from .barcodes import decode_crop
from .bmp import decode_bmp, is_bmp
from .encode import encode_png
from .engines import Reading, no_reader, reading

Reader = Callable[[np.ndarray, str], Reading]

# The formats that symbols must have to count.
_ITEM = re.compile(r"[0-9]{13}")
_DOCUMENT = re.compile(r"[0-9]{2}-[0-9]{10}")
# Fixed values of the page: the header's region, its thresholds, and from which share down a table leaves room for it.
HEADER_REGION = (0.3, 0.0, 0.7, 0.11)
HEADER_THRESHOLDS = (170, 140, 195, 0)
HEADER_SHARE = 0.15
# Fixed values of the cells: target height and threshold of each reading, paddings as shares of the cell.
NUMBER_VARIANTS = ((80, 160), (120, 0), (60, 190))
SKU_VARIANT = (140, 160)
BARCODE_PAD, NUMBER_PAD, SKU_PAD = (0.015, -0.08), (-0.14, -0.12), (-0.03, -0.05)
# Where bands are probed for barcodes, and how tall the band of totals may be.
PROBES = (0.35, 0.6, 0.85)
TOTALS_TALL = 2.5
ARCHIVE_DPI = 300

_READ = "STRUCT<text: STRING, confidence: DOUBLE>"
_READINGS = {
    "path": "string",
    "width": "int",
    "height": "int",
    "grid_found": "boolean",
    "skew_deg": "double",
    "table_top": "double",
    "column_edges": "array<int>",
    "barcode_column": "int",
    "decoded_id": "string",
    "header": f"array<{_READ}>",
    "cells": f"array<struct<band_index: int, item_barcode: string, quantity: array<{_READ}>, latin: {_READ}, cyrillic: {_READ}>>",
    "total_quantity": f"array<{_READ}>",
    "total_sum": f"array<{_READ}>",
    "archive": "binary",
    "error": "string",
}


def column_map(barcode: int, n: int) -> dict[str, int]:
    """Columns around the barcodes; those out of range are left out."""
    description = barcode - COLUMN_STEPS["barcode"]
    return {name: description + step for name, step in COLUMN_STEPS.items() if 0 <= description + step < n}


def widest(edges: list[int]) -> int | None:
    """The barcodes' column next to the widest one; None where there is no such column."""
    widths = np.diff(edges)
    at = int(np.argmax(widths)) + 1 if len(widths) >= 3 else 0
    return at if 0 < at < len(widths) else None


class Sheet:
    """A prepared page with its table, and crops of it at full resolution."""

    def __init__(self, rgb: np.ndarray):
        self.page = K.prepare_page(rgb)
        self.height, self.width = self.page.ink.shape
        self.full = self.page.rgb.shape[1] / self.width
        self.grid = K.detect_table(self.page.ink)

    def crop(self, x: int, y: int, width: int, height: int) -> np.ndarray:
        tall, wide = self.page.rgb.shape[:2]
        x, y, width, height = (round(v * self.full) for v in (x, y, width, height))
        x, y = min(max(0, x), wide - 1), min(max(0, y), tall - 1)
        return self.page.rgb[y : y + max(1, height), x : x + max(1, width)]

    def cell(self, band: int, column: int, pad: tuple[float, float]) -> np.ndarray:
        left, right = self.grid.columns[column : column + 2]
        top, bottom = self.grid.rows[band : band + 2]
        by_x, by_y = round((right - left) * pad[0]), round((bottom - top) * pad[1])
        return self.crop(left - by_x, top - by_y, max(4, right - left + 2 * by_x), max(4, bottom - top + 2 * by_y))

    def code(self, band: int, column: int) -> str | None:
        return decode_crop(K.grey(self.cell(band, column, BARCODE_PAD)), lambda t: bool(_ITEM.fullmatch(t)))

    def barcode_column(self) -> int | None:
        """The column whose bands decode, tried from the one that the widths name outwards."""
        n, bands = len(self.grid.columns) - 1, len(self.grid.rows) - 1
        named = widest(self.grid.columns)
        if named is None:
            return None
        probes = sorted({min(bands - 1, max(0, int(bands * share + 0.5))) for share in PROBES})
        tried = [c for c in (named, named + 1, named - 1, named + 2, named - 2) if 0 <= c < n]
        return next((c for c in tried if any(self.code(band, c) for band in probes)), named)


def _read(reader: Reader, planes: list[np.ndarray | None], mode: str) -> list[dict]:
    """The readings of crops that hold anything."""
    return [dict(zip(("text", "confidence"), reader(plane, mode), strict=True)) for plane in planes if plane is not None]


def _numbers(reader: Reader, crop: np.ndarray) -> list[dict]:
    plain = K.remove_blue_ink(crop)
    return _read(reader, [K.prepare_for_reading(plain, height, threshold or None) for height, threshold in NUMBER_VARIANTS], "digits")


def _header(sheet: Sheet, reader: Reader) -> dict:
    x, y, width, height = HEADER_REGION
    crop = sheet.crop(round(sheet.width * x), round(sheet.height * y), round(sheet.width * width), round(sheet.height * height))
    decoded = decode_crop(K.grey(crop), lambda t: bool(_DOCUMENT.fullmatch(t)))
    plane = K.normalized(K.remove_blue_ink(crop))
    planes = [K.binary_plane(plane, threshold) if threshold else plane for threshold in HEADER_THRESHOLDS]
    return {"decoded_id": decoded, "header": _read(reader, planes, "headerBlock")}


def _cells(sheet: Sheet, columns: dict[str, int], reader: Reader) -> Iterator[dict]:
    for band in range(len(sheet.grid.rows) - 1):
        code = sheet.code(band, columns["barcode"])
        if code is None:  # no barcode, no row, and nothing is read
            continue
        found = {"band_index": band, "item_barcode": code, "quantity": [], "latin": None, "cyrillic": None}
        if "quantity" in columns:
            found["quantity"] = _numbers(reader, sheet.cell(band, columns["quantity"], NUMBER_PAD))
        if "sku" in columns:
            ready = K.prepare_for_reading(K.remove_blue_ink(sheet.cell(band, columns["sku"], SKU_PAD)), *SKU_VARIANT)
            for mode in ("latin", "cyrillic"):
                found[mode] = next(iter(_read(reader, [ready], mode)), None)
        yield found


def _totals(sheet: Sheet, columns: dict[str, int], reader: Reader) -> dict:
    """Readings of the band between the table and the next line, if it is no taller than a total's."""
    rows, edges = sheet.grid.rows, sheet.grid.columns
    bottom = rows[-1]
    line = next((y for y in K.horizontal_lines(K.row_profile(sheet.page.ink)) if y > bottom + 4), None)
    found = {"total_quantity": [], "total_sum": []}
    if line is None or line - bottom > TOTALS_TALL * (bottom - rows[0]) / (len(rows) - 1):
        return found
    tall = line - bottom
    for name, column in (("total_quantity", "quantity"), ("total_sum", "sum")):
        if column in columns:
            left, right = edges[columns[column] : columns[column] + 2]
            found[name] = _numbers(reader, sheet.crop(left + 4, bottom + round(tall * 0.15), right - left - 8, round(tall * 0.7)))
    return found


def read_page(rgb: np.ndarray, reader: Reader = no_reader, archive: bool = False) -> dict:
    """The readings of one page; a band is a row only if its barcode decodes."""
    sheet = Sheet(rgb)
    found = {"width": sheet.width, "height": sheet.height, "skew_deg": sheet.page.skew, "grid_found": sheet.grid is not None}
    if archive:
        found["archive"] = encode_png(K.resize_width(sheet.page.rgb, K.FIXED.WORK_WIDTH), ARCHIVE_DPI)
    if sheet.grid is None:  # a page without a table may still have a header
        return found | _header(sheet, reader)
    barcode = sheet.barcode_column()
    if barcode is None:
        return found | {"grid_found": False}
    columns = column_map(barcode, len(sheet.grid.columns) - 1)
    top = sheet.grid.rows[0] / sheet.height
    found |= {"table_top": top, "column_edges": sheet.grid.columns, "barcode_column": barcode, "cells": list(_cells(sheet, columns, reader))}
    if top > HEADER_SHARE:
        found |= _header(sheet, reader)
    return found | _totals(sheet, columns, reader)


def _pixels(content: bytes | None, image: dict | None) -> np.ndarray | None:
    """RGB of an ``image`` struct (BGR, as Spark's source gives it) or of a BMP file; None for other files."""
    if image is not None:
        height, width, channels = image["height"], image["width"], image["nChannels"]
        plane = np.frombuffer(image["data"], np.uint8).reshape(height, width, channels)
        return np.repeat(plane, 3, 2) if channels == 1 else np.ascontiguousarray(plane[..., 2::-1])
    return decode_bmp(content).rgb if is_bmp(content) else None


def read_pages(files: DataFrame, reader=no_reader, archive: bool = False) -> DataFrame:
    """Readings of ``files(path, content)`` or of ``files(path, image)``, whose other columns stay.

    Set ``spark.sql.execution.arrow.maxRecordsPerBatch`` to 1 for large scans.
    """
    kept = {f.name: f.dataType.simpleString() for f in files.schema if f.name not in ("path", "content", "image")}
    schema = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in (kept | _READINGS).items()))
    arrow = to_arrow_schema(schema)
    blank = dict.fromkeys(schema.names) | {name: [] for name, kind in _READINGS.items() if kind.startswith("array")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with reading(reader) as read:
            for batch in batches:
                for row in batch.to_pylist():
                    rgb = _pixels(row.pop("content", None), row.pop("image", None))
                    found = read_page(rgb, read, archive) if rgb is not None else {"grid_found": False, "width": 0, "height": 0, "skew_deg": 0.0, "error": "not a BMP image"}
                    yield pa.RecordBatch.from_pylist([blank | row | found], schema=arrow)

    shown = [c for c in ("content", "image") if c in files.columns]
    found = files.select(*kept, "path", *shown).mapInArrow(run, schema)
    return found if archive else found.drop("archive")


def header_fields(header: Column, decoded: Column) -> Column:
    """STRUCT of the document's fields from several readings of its header and the decoded id.

    The id is the decoded one, else that of the printed number, else that of the
    text below the bars; each field is voted apart.
    """

    def settled(v: Column) -> Column:
        derived = fields.doc_id_from_number(v["number"])
        doc_id = F.coalesce(decoded, derived, v["shown"])
        return F.struct(
            doc_id.alias("doc_id"),
            F.coalesce(fields.doc_number_from_id(doc_id), v["number"]).alias("doc_number"),
            v["date"].alias("doc_date"),
            decoded.isNotNull().alias("doc_id_from_barcode"),
            F.coalesce(decoded != derived, F.lit(False)).alias("doc_id_mismatch"),
        )

    def votes(parsed: Column) -> Column:
        def of(field: str) -> Column:
            return voting.vote(F.transform(parsed, lambda p: p[field]))

        return F.struct(of("doc_number").alias("number"), of("doc_date").alias("date"), of("doc_id").alias("shown"))

    return voting.let(voting.let(F.transform(header, fields.parse_header), votes), settled)


def line_items(cells: Column) -> Column:
    """ARRAY of extracted rows: quantities by vote, SKUs from both alphabets."""

    def row(cell: Column) -> Column:
        def of(v: Column) -> Column:
            return F.struct(
                cell["band_index"].alias("band_index"),
                cell["item_barcode"].alias("item_barcode"),
                fields.merge_sku(v["latin"], v["cyrillic"]).alias("sku"),
                v["latin"].alias("sku_latin"),
                v["cyrillic"].alias("sku_cyrillic"),
                fields.parse_quantity(v["quantity"]["text"]).alias("quantity"),
                v["quantity"]["text"].alias("quantity_raw"),
                v["quantity"]["agreement"].alias("quantity_agreement"),
            )

        readings = F.struct(
            fields.normalize_sku(cell["latin"]["text"]).alias("latin"),
            fields.normalize_sku(cell["cyrillic"]["text"]).alias("cyrillic"),
            voting.vote_readings(F.transform(cell["quantity"], lambda q: q["text"])).alias("quantity"),
        )
        return voting.let(readings, of)

    return F.transform(cells, row)


def printed_total(readings: Column) -> Column:
    """The number that most readings of a total agree on."""
    return fields.parse_total(voting.vote_readings(F.transform(readings, lambda r: r["text"]))["text"])


def page_records(readings: DataFrame) -> DataFrame:
    """Page records (``schemas.PAGE_EXTRACTION``, with dpi and archive where there are) from readings.

    A page is a header page if its table begins low and a date or a decoded id
    was read; low tables without either are told by ``header_evidence_missing``.
    Fields of a page that is none stay empty, but those of a page without a table.
    ``error`` names a file that was not read; ``only_read`` refuses those.
    """
    texts = F.transform("header", lambda r: F.coalesce(r["text"], F.lit("")))
    known = readings.withColumn("h", header_fields(texts, F.col("decoded_id")))
    low = F.col("grid_found") & F.coalesce(F.col("table_top") > HEADER_SHARE, F.lit(False))
    proven = F.col("h.doc_date").isNotNull() | F.col("h.doc_id_from_barcode")
    shown = (low & proven) | (~F.col("grid_found") & (F.size("header") > 0))
    extra = [c for c in ("dpi", "archive") if c in readings.columns]
    keys = [c for c in ("batch_id", "page_index") if c in readings.columns]
    return known.select(
        *keys,
        "path",
        "width",
        "height",
        (low & proven).alias("is_header_page"),
        "skew_deg",
        *(F.when(shown, F.col(f"h.{c}")).alias(c) for c in ("doc_id", "doc_number", "doc_date")),
        (shown & F.col("h.doc_id_from_barcode")).alias("doc_id_from_barcode"),
        (shown & F.col("h.doc_id_mismatch")).alias("doc_id_mismatch"),
        (low & ~proven).alias("header_evidence_missing"),
        "grid_found",
        columns_around(F.col("barcode_column"), F.size("column_edges") - 1).alias("columns"),
        line_items(F.col("cells")).alias("rows"),
        F.struct(printed_total(F.col("total_quantity")).alias("quantity"), printed_total(F.col("total_sum")).alias("sum")).alias("totals"),
        *extra,
        "error",
    )


def only_read(records: DataFrame) -> DataFrame:
    """Page records without ``error``; a file that was not read fails the job, as its page would be lost."""
    failed = F.raise_error(F.concat(F.lit("page was not read: "), F.col("path"), F.lit(": "), F.col("error"))).cast("string")
    return records.withColumn("path", F.when(F.col("error").isNull(), F.col("path")).otherwise(failed)).drop("error")


def extract_pages(files: DataFrame, reader=no_reader, archive: bool = False) -> DataFrame:
    """Page records of image files; see ``read_pages`` and ``page_records``."""
    return page_records(read_pages(files, reader, archive))


def voted(texts: list[str | None]) -> str | None:
    """The most frequent reading, the first seen among equals."""
    seen = Counter(t for t in texts if t is not None)
    return max(seen, key=lambda t: seen[t]) if seen else None


def extract_page(rgb: np.ndarray, reader: Reader = no_reader) -> dict:
    """One page without Spark, as its table alone tells: for trying a reader or a scan.

    ``is_header_page`` is the table's place; ``page_records`` also wants evidence.
    """
    found = read_page(rgb, reader)

    def quantity(text: str | None) -> int | None:
        runs = re.findall("[0-9]+", re.sub(r"\s", "", text or ""))
        return (int(max(runs, key=len)) or None) if runs else None

    raw = [voted([q["text"] for q in cell["quantity"]]) for cell in found.get("cells", [])]
    rows = [cell | {"quantity": quantity(text), "quantity_raw": text} for cell, text in zip(found.get("cells", []), raw, strict=True)]
    low = found.get("table_top", 0.0) > HEADER_SHARE
    return found | {"is_header_page": low, "columns": found.get("column_edges", []), "rows": rows}
