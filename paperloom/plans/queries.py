"""The engine's registered queries over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fields
from ..functions import voting
from ..image import extract
from ..operators import catalogue as cat
from ..operators import layout, outputs, resolve, segment, validate
from ..sinks import tables as sinks
from ..sources import tables as sources
from ..streaming import batches
from . import adapters

#: Bytes of line items that make a further part of a step, and how many parts there are at most.
PART_BYTES, MOST_PARTS = 32 << 20, 8


@dataclass
class Run:
    """One run over the adapter's tables.

    Steps are lazy plans, but what is read several times, the segmented pages, the
    resolved items and the checked documents, is written once, as a run does.
    """

    spark: SparkSession
    sf_dir: str
    whole_dictionary: bool = False
    _paths: dict[str, str] = field(default_factory=dict)

    @cached_property
    def segmented(self) -> DataFrame:
        return segment.numbered(segment.segment_pages(adapters.pages(self.spark, self.sf_dir)))

    @cached_property
    def documents(self) -> DataFrame:
        return segment.documents(self.segmented)

    @cached_property
    def items(self) -> DataFrame:
        return segment.items(self.segmented)

    @cached_property
    def catalogue(self) -> DataFrame:
        return adapters.catalogue(self.spark, self.sf_dir)

    @cached_property
    def dictionary(self) -> DataFrame:
        entries = adapters.whole_dictionary if self.whole_dictionary else adapters.dictionary
        return entries(self.spark, self.sf_dir)

    @cached_property
    def history(self) -> DataFrame:
        return adapters.history(self.spark, self.sf_dir)

    @cached_property
    def resolved(self) -> DataFrame:
        return resolve.resolve(self.items, self.catalogue, self.dictionary)

    def _stored(self, label: str, *parts: DataFrame) -> DataFrame:
        self._paths[label] = sinks.scratch(self.spark, label)
        return sinks.stored(parts[0], self._paths[label], *parts[1:])

    def drop(self, *labels: str) -> None:
        """Nothing reads these steps any more."""
        for label in labels:
            sinks.remove(self.spark, self._paths[label])

    @cached_property
    def parts(self) -> int:
        """In how many parts by key a step is written, so that only a part's shuffle files lie on disk at a time."""
        return min(MOST_PARTS, 1 + sinks.size_of(self.spark, f"{self.sf_dir}/lineitem.parquet") // PART_BYTES)

    def in_parts(self, label: str, key: str, step: Callable[..., DataFrame]) -> DataFrame:
        """A step, given which rows to keep of each table that has the key; its parts, one after the other, are the whole."""
        return self._stored(label, *(step(adapters.part_of(key, k, self.parts)) for k in range(self.parts)))

    @cached_property
    def checked(self) -> DataFrame:
        """Checked documents; segmented pages and resolved items, as far as checks and outputs read them, are written before."""
        pages = adapters.pages(self.spark, self.sf_dir, lambda *tables: self._stored("pages", *tables), self.parts)
        self.segmented = self.in_parts("segmented", "batch_id", lambda kept: segment.numbered(segment.segment_pages(kept(pages))))
        self.drop("pages")
        self.resolved = self.in_parts("resolved", "item_barcode", self._resolved_part)
        return self.in_parts(
            "checked", "batch_id", lambda kept: validate.check_documents(segment.documents(kept(self.segmented)), kept(self.resolved), self.history)
        )

    def _resolved_part(self, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        # what is known of other barcodes need not move either
        catalogue, dictionary = (kept(t.withColumn("item_barcode", F.col("barcode"))).drop("item_barcode") for t in (self.catalogue, self.dictionary))
        return resolve.resolve(kept(self.items), catalogue, dictionary).drop("page_index", "ocr_sku", "quantity_raw")

    @cached_property
    def validated(self) -> tuple[DataFrame, DataFrame]:
        """Checked documents and flagged items; the segmented pages are gone by then."""
        documents = self.checked
        self.drop("segmented")
        return documents, validate.flag_items(documents, self.resolved)

    def output(self, rows: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Rows made of checked documents and flagged items; of large inputs they are written in parts too."""
        documents, items = self.validated
        if self.parts == 1:
            return rows(documents, items)

        def made(kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
            checked = kept(documents)
            return rows(checked, validate.flag_items(checked, kept(self.resolved)))

        written = self.in_parts("output", "batch_id", made)
        self.drop("checked", "resolved")
        return written


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n, p, d, c, cs: what the field texts below are composed of."""
    return adapters.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderkey").cast("string").alias("n"),
        F.col("o_orderpriority").alias("p"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
        F.col("o_custkey").alias("c"),
        F.col("o_custkey").cast("string").alias("cs"),
    )


def _by(key: str, modulus: int, *texts: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts[:-1]))
    return f"CASE {key} % {modulus} {cases} ELSE {texts[-1]} END"


# Readings as an OCR engine might give them, composed from the keys.
_TEXTS = {
    "quantity": _by("c", 4, "concat(n, ' ', cs)", "concat('ИЗВ ', cs, ' 7')", "concat('a', n, 'b', cs)", "'-'"),
    "total": _by("c", 3, "concat(cs, ' ', n, ' шт')", "p", "'abc'"),
    "number": _by("c", 3, "concat('№ 000', n)", "'000'", "'x'"),
    "date": _by("c", 5, "concat(d, ' 19:38:')", "concat(replace(d, '-', ' '), ' 1938')", "concat(d, 'T09:05')", "replace(d, '-', '')", "concat(p, d, '  07:', lpad(cast(c % 60 as string), 2, '0'))"),
    "sku": _by("c", 5, r"concat('AB', n, '-CIF-\nАЛЫЙ')", r"concat('AB\n', n)", r"concat('AB\r\n-C ', n)", r"concat(' A ', n, '-\n\n C')", "'  '"),
    "latin": _by("c", 4, "concat('A-B-', n)", "'A-B'", "concat('A-B-', n, '-D')", "cast(null as string)"),
    "cyrillic": _by("k", 4, "'X-Y-З'", "'X-Y-'", "'X-Y-З-Q'", "cast(null as string)"),
    "shape": _by("c", 6, "concat('A-B-Я-', n)", "'A-B'", "concat('A-B-', n)", "'A--Я'", "concat(p, '-Я')", "cast(null as string)"),
    "header": _by("c", 4, r"concat('15-', lpad(n, 10, '0'), '\n', cs, '77 ', d, ' 9:38')", "concat('15-0000164 33 ', n, '000 ', d, ' 19:38:')", "concat('tel 998', lpad(n, 9, '0'), ' x ', cs)", "concat(p, ' ', n)"),
}


def _scalar(text: str, name: str, function: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _fields(spark, sf_dir).select("k", function(F.expr(_TEXTS[text])).alias(name))

    return query


def _merge_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("k", fields.merge_sku(F.expr(_TEXTS["latin"]), F.expr(_TEXTS["cyrillic"])).alias("sku"))


def _parse_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("k", fields.parse_header(F.expr(_TEXTS["header"])).alias("h")).select("k", "h.doc_id", "h.doc_date", "h.doc_number")


def _doc_id_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _fields(spark, sf_dir).withColumn("doc_id", fields.doc_id_from_number(F.col("n")))
    return ids.select(
        "k", "doc_id", fields.doc_number_from_id(F.col("doc_id")).alias("doc_number"), fields.doc_id_from_number(F.concat("n", "cs", F.lit("0000"))).alias("long_id")
    )


# Four readings of a header, as its thresholds might give them, and what its bars decoded to.
HEADERS = [
    _by("k", 5, "concat(n, ' ', d, ' 19:38')", "concat('15-', lpad(n, 10, '0'))", "concat(n, '1 ', d, ' 9:38')", "''", "concat(cs, ' x')"),
    _by("k", 4, "concat(n, '00 ', d, ' 19:38')", "concat(n, '00 ', d, ' 08:05')", "concat('no ', p)", "concat(cs, '77 ', n, '00')"),
    _by("c", 3, "concat(n, '00 ', d, ' 19:38')", "concat('15-', lpad(n, 10, '0'), ' ', n, '00')", "''"),
    _by("c", 4, "concat(d, ' 08:05 ', n, '00')", "concat(n, '1 ', d, ' 19:38')", "concat('998200', cs, ' ', n)", "p"),
]
DECODED = _by("c", 4, "concat('15-', lpad(n, 10, '0'))", "concat('15-', lpad(concat(n, '00'), 10, '0'))", "cast(null as string)", "cast(null as string)")
CODES = _by("c", 5, "lpad(n, 13, '0')", "concat('15-', lpad(n, 10, '0'))", "lpad(n, 12, '0')", "concat(lpad(n, 13, '0'), chr(10))", "concat('15-', lpad(cs, 10, '0'), ' ')")
PATHS = _by("c", 4, "concat('//host/', n)", "concat(chr(92), chr(92), 'host', chr(92), n)", "concat('/', n)", "concat('C:/', n)")


def _header_fields(spark, sf_dir):
    texts = F.array(*map(F.expr, HEADERS))
    return _fields(spark, sf_dir).select("k", extract.header_fields(texts, F.expr(DECODED)).alias("h")).select("k", "h.*")


def _cells(spark, sf_dir):
    """Readings of one cell row for each line item: three of the quantity, one of the SKU in each alphabet."""
    q, part, supplier = F.col("l_quantity").cast("bigint").cast("string"), F.col("l_partkey"), F.col("l_suppkey")
    none = F.lit(None).cast("string")

    def reading(text):
        return F.struct(text.alias("text"), F.lit(90.0).alias("confidence"))

    texts = [
        q,
        F.when(part % 3 == 0, F.concat(F.lit("0"), q)).when(part % 3 == 1, F.concat(q, F.lit(" "), q)).otherwise(q),
        F.when(supplier % 4 == 0, F.concat(F.lit("0"), q)).when(supplier % 4 == 1, F.lit("")).otherwise(none),
    ]
    latin = F.when(supplier % 5 == 0, none).otherwise(F.concat(F.lit("AB"), part.cast("string"), F.lit("-CIF-"), F.when(part % 2 == 0, F.lit("\nALYJ")).otherwise(F.lit("ALYJ - X"))))
    cyrillic = F.when(part % 4 == 0, none).when(part % 4 == 1, F.lit("Х-Х-АЛЫЙ-Х")).otherwise(F.lit("Х-Х-\nАЛЫЙ"))
    cell = F.struct(
        F.lit(0).alias("band_index"),
        F.lpad(part.cast("string"), 13, "0").alias("item_barcode"),
        F.array(*map(reading, texts)).alias("quantity"),
        reading(latin).alias("latin"),
        reading(cyrillic).alias("cyrillic"),
    )
    return adapters.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_suppkey", "l_shipdate", cell.alias("cell"))


def _cell_readings(spark, sf_dir):
    rows = _cells(spark, sf_dir).select("k", F.col("l_linenumber").alias("line"), extract.line_items(F.array("cell"))[0].alias("r"))
    return rows.select("k", "line", "r.item_barcode", "r.sku", "r.sku_latin", "r.sku_cyrillic", "r.quantity", "r.quantity_raw", "r.quantity_agreement")


def _printed_totals(spark, sf_dir):
    rows = _cells(spark, sf_dir)
    return rows.select("k", F.col("l_linenumber").alias("line"), F.col("cell.item_barcode"), extract.printed_total(F.col("cell.quantity")).alias("total"))


def _edges(spark, sf_dir):
    return adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.sort_array(F.collect_set("l_partkey")).alias("edges"))


def _column_probe(spark, sf_dir):
    n = F.size("edges") - 1
    decoded = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda c: (F.col("page") * 7 + c * 5) % 6 == 0)
    found = _edges(spark, sf_dir).withColumn("barcode", layout.probed_column(F.col("edges"), decoded)).where("barcode is not null")
    return found.select("page", layout.columns_around(F.col("barcode"), n).alias("c")).select("page", "c.*")


def _edge_similarity(spark, sf_dir):
    """How far the edges of each order are those of the next one of its customer, as of bands of a table."""
    bands = _edges(spark, sf_dir).join(adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), "o_custkey"), "page")
    following = F.lead("edges").over(Window.partitionBy("o_custkey").orderBy("page"))
    pairs = bands.withColumn("next", following).where("next is not null")
    return pairs.select("page", layout.similarity(F.col("edges"), F.col("next"), 20).alias("similarity"))


def _accepted_codes(spark, sf_dir):
    """Which texts count as an item's barcode and which as a document's id."""
    text = F.expr(CODES)
    return _fields(spark, sf_dir).select("k", fields.accept_item_barcode(text).alias("barcode"), fields.accept_doc_id(text).alias("doc_id"))


def _network_paths(spark, sf_dir):
    path = F.expr(PATHS)
    return _fields(spark, sf_dir).select("k", fields.is_network_path(path).alias("is_network"))


def _stale_catalogues(spark, sf_dir):
    """Whether a catalogue synced at each order's time is stale, with the times that cannot be read."""
    synced = F.when(F.col("c") % 7 == 0, F.lit(None).cast("string")).when(F.col("c") % 7 == 1, "soon").otherwise(F.concat("d", F.lit("T10:00:00Z")))
    rows = _fields(spark, sf_dir)
    return rows.select("k", fields.is_stale(synced, F.col("c") % 5, F.lit("1996-01-01T12:00:00Z"), 24 * 365).alias("stale"))


def _catalogue_zip(spark, sf_dir):
    """A column of SKUs and a shorter one of barcodes, kept apart, side by side by their places."""
    return sources.read_columns(adapters.table(spark, sf_dir, "part"), "p_name", adapters.table(spark, sf_dir, "customer"), "c_custkey")


def _faulty(documents, items):
    """Fields that extraction would not let pass, so that every rule has something to find."""
    seq = F.col("doc_seq")
    bad_items = items.withColumns(
        {
            "item_barcode": F.when(F.col("row_number") % 5 == 4, F.substring("item_barcode", 1, 12)).otherwise(F.col("item_barcode")),
            "quantity": F.when(F.col("row_number") % 7 == 3, F.lit(0) - F.col("quantity")).otherwise(F.col("quantity")),
        }
    )
    bad_documents = documents.withColumns(
        {
            "doc_id": F.when((seq % 6 == 5) & (F.col("doc_id") != ""), F.concat(F.col("doc_id"), F.lit("0"))).otherwise(F.col("doc_id")),
            "doc_date": F.when(seq % 4 == 3, F.replace("doc_date", F.lit("-"), F.lit("/"))).otherwise(F.col("doc_date")),
        }
    )
    return bad_documents, bad_items


def _rule_histogram(spark, sf_dir):
    """How often each rule fires, by field, over documents and rows of which some break each of them."""
    run = Run(spark, sf_dir)
    documents, items = _faulty(run.documents, run.items)
    checked, flagged = validate.validate(documents, resolve.resolve(items, run.catalogue, run.dictionary), run.history)
    issues = checked.select(F.explode("issues").alias("i")).unionByName(flagged.select(F.explode("issues").alias("i")))
    return issues.groupBy("i.code", "i.severity", F.coalesce("i.field", F.lit("")).alias("field")).agg(F.count(F.lit(1)).alias("n"))


def _sheet_rows(spark, sf_dir):
    return Run(spark, sf_dir).output(outputs.sheet_rows)


def _log_rows(spark, sf_dir):
    return Run(spark, sf_dir).output(lambda documents, items: outputs.log_rows(documents, items, adapters.SCANNED_AT))


def _segment_documents(spark, sf_dir):
    return Run(spark, sf_dir).documents.drop("total_quantity", "total_sum")


def _orphan_pages(spark, sf_dir):
    return segment.orphan_pages(Run(spark, sf_dir).segmented).select("batch_id", "page_index")


def _totals_fallback(spark, sf_dir):
    return Run(spark, sf_dir).documents.select("batch_id", "doc_seq", "total_quantity", "total_sum")


def _row_numbers(spark, sf_dir):
    return Run(spark, sf_dir).items.select("batch_id", "doc_seq", "row_number", "page_index", "item_barcode", "quantity")


def _catalogue_lookup(spark, sf_dir):
    run = Run(spark, sf_dir)
    return resolve.lookup(run.items, run.catalogue).select("batch_id", "doc_seq", "row_number", "item_barcode", "catalogue_sku")


def _catalogue_clean(spark, sf_dir):
    return cat.first_wins(cat.clean(adapters.catalogue_raw(spark, sf_dir)))


def _catalogue_conflicts(spark, sf_dir):
    return cat.conflicts(cat.clean(adapters.catalogue_raw(spark, sf_dir)))


def _catalogue_report(spark, sf_dir):
    return cat.read_report(adapters.catalogue_raw(spark, sf_dir))


def _sku_source_mix(spark, sf_dir):
    return resolve.source_mix(Run(spark, sf_dir).resolved)


def _sku_batch_fallback(spark, sf_dir):
    run = Run(spark, sf_dir, whole_dictionary=True)
    return run.resolved.select("batch_id", "doc_seq", "row_number", "item_barcode", "ocr_sku", "sku", "sku_source", "trusted")


def _dictionary_merge(spark, sf_dir):
    run = Run(spark, sf_dir, whole_dictionary=True)
    return cat.merge_dictionary(run.dictionary, run.resolved, adapters.SCANNED_AT)


def _dictionary_confirm(spark, sf_dir):
    parts = adapters.table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("barcode"), F.col("p_brand").alias("sku"), "p_size")
    known = parts.select("barcode", "sku", F.lit("ocr").alias("source"), F.lit(1).cast("bigint").alias("seen"), F.lit("").alias("last_seen"))
    new = parts.where("p_size % 3 = 0").select("barcode", F.concat(F.lit("NEW-"), "sku").alias("sku"))
    return cat.confirm(known, new, adapters.SCANNED_AT).drop("last_seen")


def _duplicate_docs(spark, sf_dir):
    run = Run(spark, sf_dir)
    return run.documents.join(run.history, "doc_id", "left_semi").select("batch_id", "doc_seq", "doc_id")


def _new_docs(spark, sf_dir):
    run = Run(spark, sf_dir)
    return run.documents.join(run.history, "doc_id", "left_anti").select("batch_id", "doc_seq", "doc_id")


def _total_mismatch(spark, sf_dir):
    run = Run(spark, sf_dir)
    rows = validate.with_sums(run.documents, run.items).where("total_quantity <> sum_quantity")
    return rows.select("batch_id", "doc_seq", "total_quantity", "sum_quantity")


def _unreadable_cells(spark, sf_dir):
    return validate.item_sums(Run(spark, sf_dir).items).where("n_unreadable > 0").select("batch_id", "doc_seq", "n_unreadable")


def _review_rate_by_month(spark, sf_dir):
    run = Run(spark, sf_dir)
    checked = run.checked
    run.drop("segmented", "resolved")
    return outputs.review_rates(checked)


def _issue_histogram(spark, sf_dir):
    run = Run(spark, sf_dir)
    checked = run.checked
    run.drop("segmented")
    issues = checked.select(F.explode("issues").alias("i")).unionByName(validate.item_issues(run.resolved).select(F.explode("issues").alias("i")))
    return issues.groupBy("i.code", "i.severity").agg(F.count(F.lit(1)).alias("n"))


def _index_entries(spark, sf_dir):
    return validate.index_entries(Run(spark, sf_dir).checked, adapters.SCANNED_AT)


def _recent_index(spark, sf_dir):
    documents = Run(spark, sf_dir).documents.where("doc_date is not null and doc_id <> ''")
    return documents.orderBy(F.desc("doc_date"), F.desc("doc_id")).limit(20).select("doc_id", "doc_number", "doc_date")


def _run_summary(spark, sf_dir):
    run = Run(spark, sf_dir, whole_dictionary=True)
    documents = run.checked
    return outputs.run_summary(run.segmented, documents, run.resolved, run.catalogue)


def _pdf_manifest(spark, sf_dir):
    run = Run(spark, sf_dir)
    return outputs.pdf_manifest(run.segmented, run.documents, "2026-03-05").select("batch_id", "doc_seq", "pdf_path", F.size("pages").cast("bigint").alias("n_pages"))


def _page_archive(spark, sf_dir):
    """Pages of documents joined with their archived images."""
    pages = Run(spark, sf_dir).segmented.where("doc_seq > 0").select("batch_id", "doc_seq", "page_index")
    images = adapters.pages(spark, sf_dir).select("batch_id", "page_index", F.concat(F.lit("page_"), F.lpad(F.col("page_index").cast("string"), 3, "0")).alias("archive"))
    return pages.join(images, ["batch_id", "page_index"])


def _vote_field(spark, sf_dir):
    return voting.read_voted(adapters.readings(spark, sf_dir)).select("key", "text")


def _vote_agreement(spark, sf_dir):
    return voting.read_voted(adapters.readings(spark, sf_dir)).select("key", "confidence", "agreement")


def _session_batches(spark, sf_dir):
    events = adapters.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = batches.quiet_batches(events, "30 minutes", "user_id")
    return found.select("user_id", "n_files", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


def _otsu_histogram(spark, sf_dir):
    events = adapters.table(spark, sf_dir, "events").where("value >= 0")
    histogram = events.groupBy(F.least(F.floor("value"), F.lit(255)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return layout.otsu(histogram)


def _peak_merge(spark, sf_dir):
    peaks = adapters.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("line"),
        F.floor(F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))) / 600).alias("y"),
        F.round(F.col("value") * 100).cast("bigint").alias("density"),
    )
    return layout.merge_peaks(peaks.distinct(), 3)


def _longest_run(spark, sf_dir):
    orders = adapters.table(spark, sf_dir, "orders")
    bands = orders.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("band"), (F.col("o_orderstatus") == "F").alias("usable"))
    return layout.longest_run(bands)


def _widest_column(spark, sf_dir):
    edges = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.sort_array(F.collect_set("l_partkey")).alias("edges"))
    return edges.select("page", layout.resolve_columns(F.col("edges")).alias("c")).where("c is not null").select("page", "c.*")


def _upper_median(spark, sf_dir):
    values = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list("l_quantity").alias("v"))
    return values.select("page", layout.upper_median(F.col("v")).alias("median"))


def _cell_boxes(spark, sf_dir):
    left, top = F.col("l_partkey"), F.col("l_suppkey")
    box = layout.cell_box(left, top, left + 30 + F.col("l_quantity"), top + F.col("l_linenumber") * 2)
    rows = adapters.table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), left.alias("a"), top.alias("b"), box.alias("box")).select("k", "line", "a", "b", "box.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sheet_rows": _sheet_rows,
    "log_rows": _log_rows,
    "segment_documents": _segment_documents,
    "orphan_pages": _orphan_pages,
    "totals_fallback": _totals_fallback,
    "row_numbers": _row_numbers,
    "catalogue_lookup": _catalogue_lookup,
    "catalogue_clean": _catalogue_clean,
    "catalogue_conflicts": _catalogue_conflicts,
    "catalogue_report": _catalogue_report,
    "sku_source_mix": _sku_source_mix,
    "sku_batch_fallback": _sku_batch_fallback,
    "dictionary_merge": _dictionary_merge,
    "dictionary_confirm": _dictionary_confirm,
    "duplicate_docs": _duplicate_docs,
    "new_docs": _new_docs,
    "total_mismatch": _total_mismatch,
    "unreadable_cells": _unreadable_cells,
    "review_rate_by_month": _review_rate_by_month,
    "issue_histogram": _issue_histogram,
    "index_entries": _index_entries,
    "recent_index": _recent_index,
    "run_summary": _run_summary,
    "pdf_manifest": _pdf_manifest,
    "page_archive": _page_archive,
    "vote_field": _vote_field,
    "vote_agreement": _vote_agreement,
    "parse_quantity": _scalar("quantity", "quantity", fields.parse_quantity),
    "parse_total": _scalar("total", "total", fields.parse_total),
    "parse_doc_number": _scalar("number", "doc_number", fields.parse_doc_number),
    "parse_doc_date": _scalar("date", "doc_date", fields.parse_doc_date),
    "normalize_sku": _scalar("sku", "sku", fields.normalize_sku),
    "merge_sku": _merge_sku,
    "valid_sku": _scalar("shape", "valid", fields.valid_sku),
    "parse_header": _parse_header,
    "doc_id_roundtrip": _doc_id_roundtrip,
    "header_fields": _header_fields,
    "cell_readings": _cell_readings,
    "printed_totals": _printed_totals,
    "column_probe": _column_probe,
    "edge_similarity": _edge_similarity,
    "accepted_codes": _accepted_codes,
    "network_paths": _network_paths,
    "stale_catalogues": _stale_catalogues,
    "catalogue_zip": _catalogue_zip,
    "rule_histogram": _rule_histogram,
    "session_batches": _session_batches,
    "otsu_histogram": _otsu_histogram,
    "peak_merge": _peak_merge,
    "longest_run": _longest_run,
    "widest_column": _widest_column,
    "upper_median": _upper_median,
    "cell_boxes": _cell_boxes,
}
