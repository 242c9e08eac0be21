"""Sessions of a stream, hot folders, documents' PDFs, jobs and their state."""

import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperloom import config
from paperloom.image import bmp, extract
from paperloom.sinks import documents as pdfs
from paperloom.sinks import tables as sinks
from paperloom.sources import tables as sources
from paperloom.streaming import jobs, runs, sessions

from . import drawn
from .test_operators import BAR, PAGE, page


def until(ready, seconds=90):
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if ready():
            return True
        time.sleep(0.5)
    return False


def rows_of(spark, store, name):
    path = store.path(name)
    parts = [c for c in sinks.children(spark, path) if c.startswith("run=")]  # a run's folder appears when it is whole
    return spark.read.parquet(path).collect() if parts else []


def test_a_document_cut_between_micro_batches_stays_whole(spark, tmp_path):
    items = [(BAR, "A-B-Я", 2)]
    parts = [[page(0, True, rows=items)], [page(1, False, total=6, rows=items), page(2, False, rows=items)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, PAGE).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    (tmp_path / "in").mkdir()

    def arrive(k):
        for name in sorted(os.listdir(tmp_path / f"part{k}")):
            if name.endswith(".parquet"):
                os.rename(tmp_path / f"part{k}" / name, tmp_path / "in" / f"{k}-{name}")

    arrive(0)
    store = runs.Store(spark, str(tmp_path / "out"))
    stream = spark.readStream.schema(PAGE).parquet(str(tmp_path / "in"))
    query = runs.start(stream, store, str(tmp_path / "checkpoint"), once=False, quiet="12 seconds")
    try:
        assert until(lambda: query.lastProgress and query.lastProgress.batchId >= 0 and query.lastProgress.numInputRows >= 0)
        time.sleep(2)
        arrive(1)
        assert until(lambda: len(rows_of(spark, store, "summaries")) == 1)
    finally:
        query.stop()
    (summary,) = rows_of(spark, store, "summaries")
    assert (summary.documents, summary.orphan_pages, summary.rows_appended) == (1, 0, 3)
    assert [r.code for r in rows_of(spark, store, "log") if r.code.startswith("TOTAL")] == []
    (entry,) = rows_of(spark, store, "index")
    datetime.fromisoformat(entry.scannedAt)  # a time, not the number of a micro-batch


def test_sessions_are_held_apart_by_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"who":"x","n":1}\n{"who":"y","n":2}\n{"who":"x","n":3}\n{"n":4}\n')
    stream = spark.readStream.schema("who string, n int").json(str(tmp_path / "in"))
    query = sessions.close_sessions(stream, "who", "1 second").writeStream.format("memory").queryName("closed").start()
    try:
        assert until(lambda: spark.table("closed").count() == 4)
    finally:
        query.stop()
    got = {}
    for r in spark.table("closed").collect():
        got.setdefault(r.session, set()).add((r.who, r.n))
    assert sorted(map(sorted, got.values()), key=str) == sorted([[("x", 1), ("x", 3)], [("y", 2)], [(None, 4)]], key=str)


def test_unfinished_runs_make_no_duplicates_and_leave_nothing(spark, tmp_path, monkeypatch):
    store, write = runs.Store(spark, str(tmp_path)), sinks.append
    pages = spark.createDataFrame([page(0, True, rows=[(BAR, "A-B-Я", 2)])], PAGE)

    def cut(rows, path, run):
        if path.endswith("summaries"):
            raise OSError("cut off")
        write(rows, path, run)

    monkeypatch.setattr(sinks, "append", cut)
    with pytest.raises(OSError):
        runs.process(pages, store, "a", "t1")
    monkeypatch.undo()
    assert store.history("b").count() == 0
    runs.process(pages, store, "b", "t2")
    assert "DUPLICATE_DOC" not in [r.code for r in rows_of(spark, store, "log")]
    assert {r.run for name in runs.OUTPUTS for r in rows_of(spark, store, name)} == {"b"}
    assert store.history("c").count() == 1


def test_the_index_is_exported_as_lines(spark, tmp_path):
    store = runs.Store(spark, str(tmp_path / "s"))
    rows = [page(0, True, rows=[(BAR, "A-B-Я", 2)]), page(1, True, doc_id=None, number=None)]
    runs.process(spark.createDataFrame(rows, PAGE), store, "a", "t1")
    index = spark.read.parquet(store.path("index"))
    for _ in range(2):
        sinks.export_index(index, str(tmp_path / "index.jsonl"))
    assert index.count() == 2
    assert [r.docId for r in sources.read_index(spark, str(tmp_path / "index.jsonl")).collect()] == ["15-0000163307"]


def test_scan_times_are_kept(spark, tmp_path):
    store = runs.Store(spark, str(tmp_path))
    first = store.scan_time("r")
    time.sleep(0.01)
    assert store.scan_time("r") == first < store.scan_time("s")


def scanned():
    rows = [(f"{1000076316479 + k:013d}", "NOVYGOD-CIF0001-ALYJ", k + 1) for k in range(2)]
    return [drawn.page(rows, 600, ("15-0000163307", "163307", "2026-03-05 19:38")), drawn.page(rows, 60, total=6)]


def test_a_hot_folder_becomes_documents_and_pdfs(spark, tmp_path):
    folder, invoices = tmp_path / "hot", tmp_path / "invoices"
    folder.mkdir()
    store = runs.Store(spark, str(tmp_path / "store"))
    work = jobs.Jobs(store)
    watcher = jobs.Watcher(work, drawn.read)
    settings = config.Settings(hot_folder=str(folder), invoices_root=str(invoices), quiet_seconds=5)
    assert watcher.apply(settings) and watcher.watching and watcher.apply(settings)
    try:
        for k, image in enumerate(scanned()):
            (folder / f"page_{k:03d}.bmp.part").write_bytes(bmp.encode_bmp(image))
            os.rename(folder / f"page_{k:03d}.bmp.part", folder / f"page_{k:03d}.bmp")
            time.sleep(1)
        assert until(lambda: len(rows_of(spark, store, "summaries")) == 1, 180), watcher.query.exception()
    finally:
        watcher.apply(config.Settings(), enabled=False)
    assert not watcher.watching and work.state.status == "off"
    (summary,) = rows_of(spark, store, "summaries")
    assert (summary.documents, summary.orphan_pages, summary.rows_appended) == (1, 0, 4)
    (entry,) = rows_of(spark, store, "index")
    assert entry.docId == "15-0000163307" and entry.pdfPath == f"{entry.scannedAt[:10]}/15-0000163307.pdf"
    data = (invoices / entry.pdfPath).read_bytes()
    assert data.startswith(b"%PDF-") and data.count(b"/Type /Page ") == 2 and b"/Count 2" in data
    assert {r.activity for r in work.history().collect()} >= {"watching"}


def test_pdfs_are_replaced_and_pages_kept_in_order(spark, tmp_path):
    pages = [(f"p{k}", "b", k, bytearray(bmp.encode_bmp(p))) for k, p in enumerate(scanned())]
    files = spark.createDataFrame(pages, "path string, batch_id string, page_index int, content binary")
    records = extract.extract_pages(files, drawn.read, archive=True)
    store = runs.Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        runs.process(records, store, "r", "2026-03-05T19:38:00Z", str(tmp_path / "inv"))
    assert [f for _, _, names in os.walk(tmp_path / "inv") for f in names if not f.startswith(".")] == ["15-0000163307.pdf"]
    assert {r.pdf_path for r in rows_of(spark, store, "log")} <= {"2026-03-05/15-0000163307.pdf"}
    none = spark.createDataFrame([("b", 1, 0, None)], "batch_id string, doc_seq long, page_index int, archive binary")
    manifest = spark.createDataFrame([("b", 1, "x.pdf")], "batch_id string, doc_seq long, pdf_path string")
    assert pdfs.write_pdfs(none, manifest, str(tmp_path / "none")).count() == 0


def test_a_pdf_can_be_read_back():
    import re
    import zlib

    import numpy as np

    from paperloom.image import encode

    planes = [np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8), np.arange(12, dtype=np.uint8).reshape(3, 4)]
    data = encode.encode_pdf([encode.encode_png(p, 144) for p in planes])
    assert re.findall(rb"MediaBox \[0 0 ([0-9.]+) ([0-9.]+)\]", data) == [(b"3.50", b"2.50"), (b"2.00", b"1.50")]
    found = re.findall(rb"/Width (\d+) /Height (\d+).*?/Colors (\d).*?/Length (\d+) >>\nstream\n", data)
    for plane, (w, h, n, size), at in zip(planes, found, [m.end() for m in re.finditer(rb"/Columns \d+ >> /Length \d+ >>\nstream\n", data)], strict=True):
        raw = np.frombuffer(zlib.decompress(data[at : at + int(size)]), np.uint8).reshape(int(h), 1 + int(w) * int(n))
        assert (raw[:, 0] == 0).all() and (raw[:, 1:].reshape(plane.shape) == plane).all()
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start : start + 4] == b"xref"


RAW = "pos bigint, sku string, barcode string"


def test_a_failed_fetch_keeps_the_old_catalogue(spark, tmp_path):
    store = runs.Store(spark, str(tmp_path))
    assert "no catalogue" in jobs.sync_catalogue(None, store, "2026-03-05T12:00:00Z", 24).warnings[0]

    def broken():
        raise OSError("no route")

    first = jobs.sync_catalogue(broken, store, "2026-03-05T12:00:00Z", 24)
    assert (first.refreshed, first.entries) == (False, 0) and "could not be fetched: no route" in first.warnings[0]
    rows = [(0, "A", BAR), (1, "B", BAR), (2, "C", "1" * 13), (3, "x", "bad")]
    good = jobs.sync_catalogue(lambda: spark.createDataFrame(rows, RAW), store, "2026-03-05T12:00:00Z", 24, "sheet")
    assert (good.refreshed, good.entries, good.rows_read, good.skipped) == (True, 2, 4, 1)
    assert good.warnings == [f"1 conflicting rows in the catalogue: {BAR} is A, not B"]
    assert not jobs.sync_catalogue(broken, store, "2026-03-06T11:00:00Z", 24).warnings  # fresh: nothing is fetched
    late = jobs.sync_catalogue(broken, store, "2026-03-07T12:00:00Z", 24)
    assert "the old one of 2 entries stays: no route" in late.warnings[0]
    lost = jobs.sync_catalogue(lambda: spark.read.schema(RAW).parquet(str(tmp_path / "gone")), store, "2026-03-07T12:00:00Z", 24)
    assert lost.warnings and store.table("catalogue", "barcode string, sku string").count() == 2


def test_one_job_at_a_time_and_its_state(spark, tmp_path):
    work = jobs.Jobs(runs.Store(spark, str(tmp_path)))
    seen = []
    stop = work.subscribe(lambda s: seen.append(s.status))
    pages = spark.createDataFrame([page(0, True, rows=[(BAR, "A-B-Я", 2)])], PAGE)
    assert work.run("r1", pages).first().documents == 1
    assert jobs.describe(work.state).startswith("idle: 1 documents, 1 rows")
    assert work.begin("x") and not work.begin("y") and work.run("r2", pages) is None
    work.end()
    assert work.run("r3", pages.select(F.raise_error(F.lit("broken scan")).alias("batch_id"))) is None
    assert work.state.status == "error" and work.sync(lambda: 1 / 0, 0) is not None
    stop()
    work.enable(False)
    assert not work.begin("z") and jobs.describe(work.state).startswith("off") and "busy" in seen and "error" in seen
    assert work.history().where("status = 'busy'").count() >= 3
