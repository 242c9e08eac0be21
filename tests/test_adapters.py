"""The adapter's tables hold what the queries on them have to work through."""

from pathlib import Path

import pytest

from paperloom.plans import catalog, oracle
from paperloom.plans.queries import Run

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def lacking(spark):
    return spark.read.parquet(f"{SF}/part.parquet").where("p_size >= 40").selectExpr("lpad(cast(p_partkey as string), 13, '0') as barcode", "p_partkey % 8 = 0 as confirmed")


def test_the_whole_dictionary_has_every_part_that_the_catalogue_lacks(spark):
    found = {(r.barcode, r.source == "confirmed") for r in Run(spark, SF, whole_dictionary=True).dictionary.collect()}
    assert found == {tuple(r) for r in lacking(spark).collect()}
    assert "p_type IN" in oracle.ADAPTER and "p_type IN" not in oracle.WHOLE and "p_type =" not in oracle.WHOLE


def test_resolution_leaves_no_row_without_a_sku(spark):
    found = catalog.queries()["sku_batch_fallback"](spark, SF)
    assert found.where("sku is null or sku_source = 'none'").count() == 0


def test_a_merge_keeps_entries_that_no_row_names(spark):
    found = {r.barcode: (r.source == "confirmed") for r in catalog.queries()["dictionary_merge"](spark, SF).collect()}
    assert found == {r.barcode: r.confirmed for r in lacking(spark).collect()}


def test_the_summary_counts_rows_of_every_entry_from_ocr(spark):
    codes = [r.barcode for r in lacking(spark).where("not confirmed").collect()]
    items = Run(spark, SF).items
    assert catalog.queries()["run_summary"](spark, SF).first().sku_from_ocr == items.where(items.item_barcode.isin(codes)).count()
