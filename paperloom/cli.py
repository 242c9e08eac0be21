"""Runs from the command line.

    python -m paperloom.cli pages PAGES STORE RUN       page records (schemas.PAGE_EXTRACTION, Parquet)
    python -m paperloom.cli ingest FOLDER STORE RUN     image files of a folder, or of one batch for each folder in it
    python -m paperloom.cli scan FOLDER STORE RUN       the same of a scanner's landing folder, of bounded length
    python -m paperloom.cli sync-catalogue TABLE STORE  a table of (pos, sku, barcode), Parquet
    python -m paperloom.cli watch STORE SETTINGS        the hot folder of a settings file, until it is stopped

Options: --reader MODULE:NAME for a function or EngineFactory that reads text;
--invoices FOLDER for PDFs.  ``PAGES STORE RUN`` alone still processes page records.
"""

from __future__ import annotations

import argparse
import sys
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .image.engines import no_reader
from .image.extract import extract_pages
from .sources import images, scanner
from .streaming import jobs, runs

#: Documents and rows that the report shows; the tables hold all.
SHOWN_DOCUMENTS, SHOWN_ROWS = 50, 200


def _reader(name: str | None):
    if not name:
        return no_reader
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def report(store: runs.Store, run: str, summary) -> list[str]:
    """The run as lines of text: its first documents with rows and issues, then the counters."""
    spark = store.spark
    own = F.col("run") == run
    rows = spark.read.parquet(store.path("rows")).where(own)
    entries = spark.read.parquet(store.path("index")).where(own).orderBy("docId").limit(SHOWN_DOCUMENTS).collect()
    log = spark.read.parquet(store.path("log")).where(own)
    shown: dict[str, list] = {}
    for row in rows.orderBy("doc_id", "batch_id", "doc_seq", "row_number").limit(SHOWN_ROWS).collect():
        shown.setdefault(row["doc_id"], []).append(row)
    lines = []
    for entry in entries:
        flagged = f", {entry['flagged']} flags" if entry["flagged"] else ""
        lines.append(f"{entry['docId'] or '(no id)'}  {entry['docNumber'] or '-'}  {entry['docDate'] or '-'}  {entry['rows']} rows{flagged}")
        if entry["pdfPath"]:
            lines.append(f"  PDF: {entry['pdfPath']}")
        for row in shown.get(entry["docId"], []):
            quantity = "-" if row["quantity"] is None else row["quantity"]
            lines.append(f"  {row['row_number']:>3}  {row['item_barcode']}  {quantity:>4}  {row['sku'] or '-'}{' ' + row['flag'] if row['flag'] else ''}")
    lines += [f"{r['severity']} {r['code']}: {r['n']}" for r in log.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n")).orderBy("severity", "code").collect()]
    return [*lines, *(f"{name}: {value}" for name, value in summary.asDict().items())]


def _process(pages: DataFrame, store: runs.Store, run: str, invoices: str | None) -> int:
    summary = runs.process(pages, store, run, store.scan_time(run), invoices).first()
    print("\n".join(report(store, run, summary)))
    return 0


def _images(spark: SparkSession, folder: str, reader, archive: bool) -> DataFrame:
    return extract_pages(images.read_images(spark, folder, recursive=True), reader, archive)


def _watch(store: runs.Store, path: str, reader) -> int:
    watcher = jobs.Watcher(jobs.Jobs(store), reader)
    if not watcher.apply(config.load(path)):
        print("the settings name no hot folder")
        return 1
    watcher.query.awaitTermination()
    return 0


def main(args: list[str], spark: SparkSession | None = None) -> int:
    commands = ("pages", "ingest", "scan", "sync-catalogue", "watch")
    if len(args) == 3 and args[0] not in commands:
        args = ["pages", *args]
    parser = argparse.ArgumentParser(prog="paperloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=commands)
    parser.add_argument("places", nargs="+")
    parser.add_argument("--reader")
    parser.add_argument("--invoices")
    try:
        chosen = parser.parse_args(args)
    except SystemExit as stop:
        return int(stop.code or 0)
    wanted = 2 if chosen.command in ("sync-catalogue", "watch") else 3
    if len(chosen.places) != wanted:
        print(f"{chosen.command} takes {wanted} places; see --help")
        return 2
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    if chosen.command == "watch":
        return _watch(runs.Store(spark, chosen.places[0]), chosen.places[1], _reader(chosen.reader))
    source, store = chosen.places[0], runs.Store(spark, chosen.places[1])
    if chosen.command == "sync-catalogue":
        found = jobs.sync_catalogue(lambda: spark.read.parquet(source), store, jobs.now_text(), 0, source)
        print(f"catalogue: {found.entries} entries ({'synced' if found.refreshed else 'not synced'}), {found.rows_read} rows read, {found.skipped} skipped")
        print("\n".join(f"WARNING: {w}" for w in found.warnings))
        return 0 if found.refreshed else 1
    run = chosen.places[2]
    if chosen.command == "pages":
        return _process(spark.read.parquet(source), store, run, chosen.invoices)
    if chosen.command == "scan":
        try:
            scanner.scan_batch(spark, source, run)  # refuses empty folders and those of too many pages
        except scanner.ScanError as error:
            print(f"{error.code}: {error}")
            return 1
    return _process(_images(spark, source, _reader(chosen.reader), bool(chosen.invoices)), store, run, chosen.invoices)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
