"""What the validated queries move and leave behind."""

from pathlib import Path

import pytest

from paperloom.operators import segment
from paperloom.plans import adapters, catalog
from paperloom.plans.queries import Run

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture
def unhinted(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moves(table):
    return table._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pages_move_once_by_part_by_order_and_by_batch(unhinted):
    # parts, line items by part and by order, orders, pages by batch
    pages = adapters.pages(unhinted, SF)
    assert moves(pages) == 5 == moves(segment.items(segment.segment_pages(pages)))


@pytest.mark.parametrize("name", ["run_summary", "review_rate_by_month", "index_entries", "issue_histogram"])
def test_counts_of_rows_join_no_items(unhinted, name):
    assert "Join" not in catalog.queries()[name](unhinted, SF)._jdf.queryExecution().executedPlan().toString()


def test_steps_that_are_read_no_more_are_removed(spark):
    run = Run(spark, SF)
    documents, items = run.validated
    left = {label for label, path in run._paths.items() if Path(path.removeprefix("file:")).exists()}
    assert left == {"resolved", "checked"} and set(run._paths) == left | {"pages", "segmented"}
    assert documents.count() and items.count()


@pytest.mark.parametrize("name", ["sheet_rows", "log_rows", "review_rate_by_month", "issue_histogram"])
def test_large_inputs_are_worked_off_in_parts(spark, monkeypatch, name):
    from paperloom.plans import queries

    whole = catalog.queries()[name](spark, SF)
    paths, sizes = {}, []
    monkeypatch.setattr(queries, "PART_BYTES", 1 << 15)
    real, scratch = queries.sinks.stored, queries.sinks.scratch
    monkeypatch.setattr(queries.sinks, "scratch", lambda spark, label: paths.setdefault(label, scratch(spark, label)))
    monkeypatch.setattr(queries.sinks, "stored", lambda table, path, *more: sizes.append(1 + len(more)) or real(table, path, *more))
    parts = catalog.queries()[name](spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    assert len(sizes) >= 4 and min(sizes) > 1
    left = {label for label, path in paths.items() if Path(path.removeprefix("file:")).exists()}
    assert left == {"sheet_rows": {"output"}, "log_rows": {"output"}, "review_rate_by_month": {"checked"}, "issue_histogram": {"checked", "resolved"}}[name]
