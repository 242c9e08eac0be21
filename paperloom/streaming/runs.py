"""Runs over page records, in batch or from a stream.

State between runs is two tables, the dictionary and the document index, and
both change once per run: outputs are keyed by the run, so replays replace.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_stale
from ..image.engines import no_reader
from ..image.extract import extract_pages, only_read
from ..operators import catalogue as cat
from ..operators import outputs, resolve, segment, validate
from ..schemas import SKU_CATALOGUE, SKU_DICTIONARY
from ..sinks import tables as sinks
from ..sinks.documents import write_pdfs
from ..sources import images
from ..sources import tables as sources
from . import sessions
from .batches import QUIET, hot_folder

#: What each run writes to, the summary last.
OUTPUTS = ("rows", "log", "index", "summaries")
# Fixed value: a file that did not change for so long is whole.
STABLE_SECONDS = 2.0
#: What a swap that was cut off leaves behind.
_UNFINISHED = re.compile(r"\.([0-9a-f]{32}|old)$")


@dataclass
class Store:
    """Paths of a deployment's tables."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table(self, name: str, schema: str) -> DataFrame:
        sinks.recover(self.spark, self.path(name))
        if sources.exists(self.spark, self.path(name)):
            return self.spark.read.parquet(self.path(name))
        return self.spark.createDataFrame([], schema)

    def finished(self, run: str) -> bool:
        """Whether the run wrote its summary, which comes last."""
        if not sources.exists(self.spark, self.path("summaries")):
            return False
        return self.spark.read.parquet(self.path("summaries")).where(F.col("run") == run).limit(1).count() > 0

    def dictionary_before(self, run: str) -> DataFrame:
        """The dictionary as it was before the run, kept for a replay.

        Only the last run's copy is kept.  What a run learnt that did not finish is
        taken back by the next; a finished run before the last cannot be repeated,
        as that would undo what later ones learnt.
        """
        folder, copies = self.path("dictionary-before"), sinks.children(self.spark, self.path("dictionary-before"))
        if run not in copies:
            if self.finished(run):
                raise ValueError(f"run {run} is not the last one and cannot be repeated")
            cut_off = [c for c in copies if not _UNFINISHED.search(c) and not self.finished(c)]
            source = self.spark.read.parquet(f"{folder}/{cut_off[0]}") if cut_off else self.table("dictionary", SKU_DICTIONARY)
            sinks.replace(source, f"{folder}/{run}")
        for copy in copies:
            if copy != run:
                sinks.remove(self.spark, f"{folder}/{copy}")
        return self.spark.read.parquet(f"{folder}/{run}")

    def history(self, run: str) -> DataFrame:
        """Ids of documents that other runs processed to their end."""
        if not sources.exists(self.spark, self.path("index")) or not sources.exists(self.spark, self.path("summaries")):
            return self.spark.createDataFrame([], "doc_id string")
        index = self.spark.read.parquet(self.path("index")).where((F.col("docId") != "") & (F.col("run") != run))
        done = self.spark.read.parquet(self.path("summaries")).select("run").distinct()
        return index.join(done, "run", "left_semi").select(F.col("docId").alias("doc_id"))

    def clear_unfinished(self) -> list[str]:
        """Removes what runs wrote that were cut off before their summary; gives their partitions.

        One run is active at a time, so a run without a summary is none that works.
        """
        done = set(sinks.children(self.spark, self.path("summaries")))
        cut = set()
        for table in OUTPUTS:
            for part in sinks.children(self.spark, self.path(table)):
                if part.startswith("run=") and part not in done:
                    sinks.remove(self.spark, f"{self.path(table)}/{part}")
                    cut.add(part)
        return sorted(cut)

    def scan_time(self, run: str) -> str:
        """When the run was first begun, as ISO text in UTC; a replay gets the same."""
        path = self.path(f"scans/{run}")
        if not sources.exists(self.spark, path):
            now = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
            sinks.replace(self.spark.createDataFrame([(now,)], "scanned_at string").coalesce(1), path)
        return self.spark.read.parquet(path).first()["scanned_at"]


def process(pages: DataFrame, store: Store, run: str, scanned_at: str, invoices: str | None = None) -> DataFrame:
    """Processes page records and writes all outputs; gives the run's summary.

    The latest run may be repeated, as a stream does after a failure: every
    output is replaced by the same rows.  Each step is written once and all
    outputs read it.  With ``invoices`` and archived images in ``pages``, each
    document's PDF is written below that folder and named in log and index.
    """
    store.clear_unfinished()
    catalogue = store.table("catalogue", SKU_CATALOGUE)
    before = store.dictionary_before(run)
    work = store.path(f"work/{run}")

    def step(name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{work}/{name}")
        return store.spark.read.parquet(f"{work}/{name}")

    extracted = [c for c in ("archive", "error") if c in pages.columns]
    if extracted:  # read once, and no image is shuffled but for its PDF
        pages = step("pages", only_read(pages) if "error" in extracted else pages)
    segmented = step("segmented", segment.segment_pages(pages.drop("archive")))
    resolved = step("resolved", resolve.resolve(segment.items(segmented), catalogue, before))
    validated = validate.validate(segment.documents(segmented), resolved, store.history(run))
    documents, items = (step(name, table) for name, table in zip(("documents", "items"), validated, strict=True))
    if invoices and "archive" in extracted:
        manifest = outputs.pdf_manifest(segmented, documents, scanned_at[:10])
        archived = segmented.select("batch_id", "doc_seq", "page_index").join(pages.select("batch_id", "page_index", "archive"), ["batch_id", "page_index"])
        written = step("pdfs", write_pdfs(archived, manifest, invoices)).select("batch_id", "doc_seq", "pdf_path")
        documents = documents.join(written, ["batch_id", "doc_seq"], "left")
    sinks.append(outputs.sheet_rows(documents, items), store.path("rows"), run)
    sinks.append(outputs.log_rows(documents, items, scanned_at), store.path("log"), run)
    sinks.replace(cat.merge_dictionary(before, resolved, scanned_at), store.path("dictionary"))
    sinks.append(validate.index_entries(documents, scanned_at), store.path("index"), run)
    sinks.append(outputs.run_summary(segmented, documents, items, catalogue), store.path("summaries"), run)
    sinks.remove(store.spark, work)
    return store.spark.read.parquet(store.path("summaries")).where(F.col("run") == run).drop("run")


def sync_catalogue(raw: DataFrame, store: Store, now: str, max_age_hours: int, synced_at: str | None) -> DataFrame | None:
    """Replaces the catalogue if it is stale; gives the report, or None if fresh."""
    n = store.table("catalogue", SKU_CATALOGUE).limit(1).count()
    check = store.spark.range(1).select(is_stale(F.lit(synced_at).cast("string"), F.lit(n), F.lit(now), max_age_hours).alias("stale"))
    if not check.first()["stale"]:
        return None
    sinks.replace(cat.first_wins(cat.clean(raw)), store.path("catalogue"))
    return cat.read_report(raw)


def start(pages: DataFrame, store: Store, checkpoint: str, once: bool = True, quiet: str | None = None, invoices: str | None = None):
    """Runs a stream of page records: each micro-batch, or each session of a batch's pages, as one run.

    Without ``quiet`` a micro-batch is a run, and a document's pages must arrive in
    one.  With it, the pages of a ``batch_id`` are held until none came for that
    period, so a document that is cut between micro-batches stays whole; use
    ``once=False`` then, as a session closes some time after its last page.
    Micro-batches are serial, so one run at a time is active.  Runs carry the
    query's id, which its checkpoint keeps: a restart replaces its own outputs, and
    a query with a new checkpoint none of those of others.
    """
    if quiet is not None:
        closed = sessions.close_sessions(pages, "batch_id", quiet)
        pages = closed.withColumn("batch_id", F.concat_ws("/", "batch_id", "session")).drop("session")

    def each(batch: DataFrame, number: int) -> None:
        if quiet is not None and batch.isEmpty():  # nothing closed
            return
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        run = f"stream-{query}-{number:09d}"
        process(batch, store, run, store.scan_time(run), invoices)

    writer = pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch(folder: str, store: Store, checkpoint: str, reader=no_reader, quiet: str = QUIET, invoices: str | None = None, name: str | None = None):
    """Runs the image files of a hot folder, each quiet period's arrivals as one batch.

    The stream carries paths alone.  Files are read when their session closes, so
    after no file came for the quiet period; one that is still being written then
    (changed within ``STABLE_SECONDS``) is waited for.
    """
    found = hot_folder(store.spark, folder).select("path", "ts", F.lit(folder).alias("folder"))
    closed = sessions.close_sessions(found, "folder", quiet)

    def each(batch: DataFrame, number: int) -> None:
        arrived = sorted((r["session"], r["path"]) for r in batch.select("session", "path").collect())  # one scan batch's paths
        if not arrived:
            return
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        run = f"watch-{query}-{number:09d}"
        paths = [path for _, path in arrived]
        wait_until_stable(spark, paths)
        named = spark.createDataFrame([(session, k, path) for k, (session, path) in enumerate(arrived)], "batch_id string, page_index int, path string")
        files = images.load_images(spark, paths).join(F.broadcast(named), "path")
        process(extract_pages(files, reader, archive=invoices is not None), store, run, store.scan_time(run), invoices)

    writer = closed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).start()


def wait_until_stable(spark: SparkSession, paths: list[str], stable: float = STABLE_SECONDS, most: float = 600.0) -> None:
    """Returns once no file changed within ``stable`` seconds; an error after ``most``."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    until = time.monotonic() + most
    while True:
        young = 0.0
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            age = time.time() - at.getFileSystem(conf).getFileStatus(at).getModificationTime() / 1000
            young = max(young, min(stable, stable - age))
        if young <= 0:
            return
        if time.monotonic() > until:
            raise TimeoutError(f"files are still being written after {most:g} s")
        time.sleep(young)
