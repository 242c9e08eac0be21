"""Sources, sinks, settings and runs, in batch and from a stream."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom import config
from paperloom.operators import catalogue as cat
from paperloom.plans import catalog
from paperloom.sinks import tables as sinks
from paperloom.sources import scanner
from paperloom.sources import tables as sources
from paperloom.streaming import batches, runs

from .test_operators import BAR, PAGE, page


def test_settings_layers(tmp_path):
    path = str(tmp_path / "settings.json")
    config.save(config.Settings(spreadsheet_id="stored"), path)
    env = {"PAPERLOOM_SPREADSHEET_ID": "env", "PAPERLOOM_CATALOGUE_ID": "c", "PAPERLOOM_SHEET": "s"}
    settings = config.load(path, env)
    assert (settings.spreadsheet_id, settings.catalogue_id, settings.sheet_name) == ("stored", "c", "s")
    assert settings.missing() == ["hot_folder"] and not settings.is_configured()
    with pytest.raises(ValueError):
        config.Settings(max_pages=0)
    (tmp_path / ".env").write_text("# x\nA=1\nB='two'\n")
    assert config.read_env_file(str(tmp_path / ".env")) == {"A": "1", "B": "two"}


def test_stored_maps_and_index(spark, tmp_path):
    missing = str(tmp_path / "none.json")
    assert sources.read_catalogue(spark, missing).count() == 0 == sources.read_dictionary(spark, missing).count() == sources.read_index(spark, missing).count()
    path = str(tmp_path / "catalogue.json")
    sinks.save_map(spark.createDataFrame([("2", "B"), ("1", "А")], "barcode string, sku string"), path, syncedAt="t", source="x")
    assert list(json.loads(open(path).read())["entries"]) == ["1", "2"]
    assert {r.barcode: r.sku for r in sources.read_catalogue(spark, path).collect()} == {"1": "А", "2": "B"}
    assert sources.catalogue_synced_at(spark, path) == "t"
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception):
        sources.read_catalogue(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "d.json").write_text(json.dumps({"entries": {"1": {"sku": "A", "source": "ocr", "seen": 2, "lastSeen": "t"}, "2": {"seen": 1}}}))
    assert [(r.barcode, r.seen) for r in sources.read_dictionary(spark, str(tmp_path / "d.json")).collect()] == [("1", 2)]
    (tmp_path / "index.jsonl").write_text('{"docId":"a","rows":1}\n\nbroken\n{"docId":"","rows":2}\n')
    assert [r.docId for r in sources.read_index(spark, str(tmp_path / "index.jsonl")).collect()] == ["a"]


def test_replace_truncate_and_head(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.ensure_table(spark, path, "a int") and not sinks.ensure_table(spark, path, "a int")
    sinks.replace(spark.range(5).selectExpr("cast(id as int) a"), path)
    assert sinks.head(spark, path, 2)[1] == 5
    sinks.truncate(spark, path)
    assert sinks.head(spark, path)[1] == 0


def test_image_listing(spark, tmp_path):
    for name in ("b.PNG", "a.bmp", "c.txt", "d.jpeg"):
        (tmp_path / name).write_bytes(b"x")
    got = scanner.scan_batch(spark, str(tmp_path), "s1").orderBy("page_index").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.bmp", "b.PNG", "d.jpeg"]
    with pytest.raises(scanner.ScanError):
        scanner.scan_batch(spark, str(tmp_path / "none"), "s")


def pages(spark):
    rows = [(BAR, "A-B-Я", 2), (BAR, None, 2)]
    return spark.createDataFrame([page(0, True, total=4, rows=rows), page(1, True, doc_id="15-0000000001", total=9, rows=rows)], PAGE)


def test_a_replayed_run_changes_nothing(spark, tmp_path):
    store = runs.Store(spark, str(tmp_path))
    first = runs.process(pages(spark), store, "r1", "t1").first()
    again = runs.process(pages(spark), store, "r1", "t1").first()
    assert first == again and first.documents == 2 and first.rows_appended == 4
    assert spark.read.parquet(store.path("rows")).count() == 4
    assert [r.seen for r in spark.read.parquet(store.path("dictionary")).collect()] == [4]
    runs.process(pages(spark), store, "r2", "t2")
    codes = [r.code for r in spark.read.parquet(store.path("log")).where("run = 'r2'").collect()]
    assert codes.count("DUPLICATE_DOC") == 2


def test_stream_equals_batch(spark, tmp_path):
    pages(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PAGE).parquet(str(tmp_path / "in"))
    store = runs.Store(spark, str(tmp_path / "out"))
    runs.start(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    whole = runs.Store(spark, str(tmp_path / "whole"))
    runs.process(pages(spark), whole, "r", "batch 0")
    for name in ("rows", "log", "index"):
        one, other = (sorted(map(str, spark.read.parquet(s.path(name)).drop("run", "scanned_at", "scannedAt").collect())) for s in (store, whole))
        assert one == other


def test_catalogue_is_synced_when_stale(spark, tmp_path):
    store = runs.Store(spark, str(tmp_path))
    raw = spark.createDataFrame([(0, "A", BAR)], "pos bigint, sku string, barcode string")
    assert runs.sync_catalogue(raw, store, "2026-03-05T12:00:00Z", 24, None).first().entries == 1
    assert runs.sync_catalogue(raw, store, "2026-03-05T12:00:00Z", 24, "2026-03-05T11:00:00Z") is None


def test_quiet_periods_close_batches(spark):
    seconds = [0, 3, 7, 12, 13]
    rows = spark.createDataFrame([(s, f"p{s}") for s in seconds], "s int, path string").select(F.timestamp_seconds("s").alias("ts"), "path")
    got = sorted(r.paths for r in batches.quiet_batches(rows).collect())
    # a gap of exactly the period still belongs
    assert got == [["p0", "p3", "p7"], ["p12", "p13"]]


def test_a_swap_that_was_cut_off_is_recovered(spark, tmp_path):
    store = runs.Store(spark, str(tmp_path))
    spark.range(3).write.parquet(store.path("dictionary") + ".old")
    assert store.table("dictionary", "id long").count() == 3
    sinks.replace(spark.range(5), store.path("dictionary"))
    assert store.table("dictionary", "id long").count() == 5


def test_too_many_pages_are_an_error(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"page_{k:03d}.bmp").write_bytes(b"BM")
    assert scanner.scan_batch(spark, str(tmp_path), "s", 4).count() == 4
    with pytest.raises(scanner.ScanError) as raised:
        scanner.scan_batch(spark, str(tmp_path), "s", 3)
    assert raised.value.code == "TOO_MANY_PAGES"


def test_only_the_last_run_is_repeated(spark, tmp_path):
    store = runs.Store(spark, str(tmp_path))
    for run in ("r1", "r2"):
        runs.process(pages(spark), store, run, run)
    with pytest.raises(ValueError):
        runs.process(pages(spark), store, "r1", "r1")
    assert [r.seen for r in spark.read.parquet(store.path("dictionary")).collect()] == [8]
    assert sinks.children(spark, store.path("dictionary-before")) == ["r2"]
    assert sinks.children(spark, store.path("work")) == []


def test_what_an_unfinished_run_learnt_is_taken_back(spark, tmp_path, monkeypatch):
    store, write = runs.Store(spark, str(tmp_path)), sinks.append

    def cut(rows, path, run):
        if path.endswith("summaries"):
            raise OSError("cut off")
        write(rows, path, run)

    monkeypatch.setattr(sinks, "append", cut)
    with pytest.raises(OSError):
        runs.process(pages(spark), store, "r1", "t1")
    assert [r.seen for r in spark.read.parquet(store.path("dictionary")).collect()] == [4]
    monkeypatch.undo()
    runs.process(pages(spark), store, "r2", "t2")
    assert [r.seen for r in spark.read.parquet(store.path("dictionary")).collect()] == [4]
    runs.process(pages(spark), store, "r1", "t1")
    assert [r.seen for r in spark.read.parquet(store.path("dictionary")).collect()] == [8]


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    table = spark.createDataFrame([("1", "a" * 100), ("2", None)], "barcode string, sku string")
    assert hinted(cat.small(table)) and not hinted(cat.small(table, rows=1)) and not hinted(cat.small(table, size=100))


def test_run_summary_joins_nothing(spark, tmp_path):
    plan = catalog.queries()["run_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sheet_rows_reads_each_step_once(spark):
    plan = catalog.queries()["sheet_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") <= 12 and "lineitem.parquet" not in plan
