"""The engine's inputs built from star-schema tables.

Orders stand for documents, line items for their rows, parts for the
catalogue, customers for scan batches and events for arrivals.  Every choice
below exercises a rule; see ``oracle.ADAPTER`` for the same in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_PAGE = 3
SCANNED_AT = "2026-03-05T19:38:00.000Z"
HISTORY_BEFORE = "1996-01-01"
COLOURS = ("АЛЫЙ", "БЕЛЫЙ", "СИНИЙ")
_ROW_ORDER = (
    "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(key: str, n: int) -> Column:
    return F.lpad(F.col(key).cast("string"), n, "0")


def part_sku() -> Column:
    """A SKU of Latin, Latin and Cyrillic segments, as the shape rule wants."""
    colour = F.element_at(F.array(*map(F.lit, COLOURS)), (F.col("p_partkey") % 3 + 1).cast("int"))
    brand = F.upper(F.replace("p_brand", F.lit("#"), F.lit("")))
    return F.concat_ws("-", brand, F.upper(F.replace("p_type", F.lit(" "), F.lit(""))), colour)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """barcode, sku of about four fifths of the parts."""
    return table(spark, sf_dir, "part").where("p_size < 40").select(_padded("p_partkey", 13).alias("barcode"), part_sku().alias("sku"))


def catalogue_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, sku, barcode with bad barcodes, empty SKUs and repeated barcodes."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("pos"),
        F.when(key % 17 == 0, F.lit(" ")).otherwise(F.concat_ws("-", "p_brand", "p_type")).alias("sku"),
        F.when(key % 13 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(F.lpad((key % 150).cast("string"), 13, "0")).alias("barcode"),
    )


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the parts that the catalogue lacks which were sold as promotion or economy, confirmed or from OCR.

    Parts of other types are unknown to both tables, so resolution has rows without a SKU to report.
    """
    rows = table(spark, sf_dir, "part").where("p_size >= 40 and p_type in ('PROMO', 'ECONOMY')")
    return _entries(rows, F.col("p_type") == "PROMO")


def whole_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part that the catalogue lacks, confirmed or from OCR."""
    return _entries(table(spark, sf_dir, "part").where("p_size >= 40"), F.col("p_partkey") % 8 == 0)


def _entries(parts: DataFrame, confirmed: Column) -> DataFrame:
    return parts.select(
        _padded("p_partkey", 13).alias("barcode"),
        F.concat(F.lit("OLD-"), part_sku()).alias("sku"),
        F.when(confirmed, "confirmed").otherwise("ocr").alias("source"),
        F.lit(1).cast("bigint").alias("seen"),
        F.lit("2026-01-01T00:00:00.000Z").alias("last_seen"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the orders before a day: those of previous runs."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(HISTORY_BEFORE).cast("timestamp_ntz"))
    return orders.select(F.concat(F.lit("15-"), _padded("o_orderkey", 10)).alias("doc_id"))


def rows(spark: SparkSession, sf_dir: str, kept: Callable[[DataFrame], DataFrame] = lambda table: table) -> DataFrame:
    """One row per line item, numbered within its order.

    Line items that are alike in the columns of this order are alike in all that is
    taken from them, so no other column is moved; parts come first, so that pages
    keep the partitions that rows are numbered in.
    """
    columns = ["l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("quantity")]
    order = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), part_sku().alias("part_sku"))
    items = kept(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *columns)).join(parts, "l_partkey", "left")
    return items.withColumn("rn", F.row_number().over(order))


def _cell(row: Column, band: Column) -> Column:
    """The cells of a row as they are read: SKUs are missing, without dashes or with a size, quantities sometimes unread."""
    supplier = row["l_suppkey"]
    size = F.concat(F.lit("-"), (row["l_linenumber"] % 3).cast("string"), F.lit("sm"))
    sku = (
        F.when(supplier % 5 == 0, F.lit(None).cast("string"))
        .when(supplier % 7 == 0, F.replace(row["part_sku"], F.lit("-"), F.lit("")))
        .otherwise(F.concat(row["part_sku"], size))
    )
    quantity = F.when((row["l_partkey"] + supplier) % 41 != 0, row["quantity"])
    return F.struct(
        band.alias("band_index"),
        F.lpad(row["l_partkey"].cast("string"), 13, "0").alias("item_barcode"),
        sku.alias("sku"),
        quantity.alias("quantity"),
        quantity.cast("string").alias("quantity_raw"),
    )


def part_of(key: str, part: int, parts: int) -> Callable[[DataFrame], DataFrame]:
    """The rows of one of several parts by key; all parts together are the whole table."""
    return lambda rows: rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else rows


def pages(spark: SparkSession, sf_dir: str, step: Callable[..., DataFrame] = lambda table: table, parts: int = 1) -> DataFrame:
    """The page stream: three rows a page, a batch per customer.

    ``step`` may write the pages of orders, in so many parts, before they move to their batches.
    """
    of_orders = step(*(_pages_of_orders(spark, sf_dir, part_of("o_orderkey", k, parts)) for k in range(parts)))
    of_batch = Window.partitionBy("batch_id").orderBy("o_orderkey", "page_no")
    key = F.col("o_orderkey")
    placed = of_orders.withColumn("page_index", F.row_number().over(of_batch) - 1)
    # texts are composed after the pages have moved
    cells = F.coalesce(F.transform("cells", _cell), F.array().cast("array<struct<band_index:int,item_barcode:string,sku:string,quantity:bigint,quantity_raw:string>>"))
    return placed.select(
        "batch_id",
        "page_index",
        ((F.col("page_no") == 0) & (key % 11 != 0)).alias("is_header_page"),
        F.when(key % 23 != 0, F.concat(F.lit("15-"), _padded("o_orderkey", 10))).alias("doc_id"),
        F.when(key % 29 != 0, key.cast("string")).alias("doc_number"),
        F.when(key % 31 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("doc_date"),
        (key % 37 == 0).alias("doc_id_mismatch"),
        "totals",
        cells.alias("rows"),
    )


def _pages_of_orders(spark: SparkSession, sf_dir: str, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    orders = kept(table(spark, sf_dir, "orders"))
    page_no = F.floor((F.col("rn") - 1) / ROWS_PER_PAGE).cast("int").alias("page_no")
    of_pages = rows(spark, sf_dir, kept).groupBy("o_orderkey", page_no).agg(
        F.sort_array(F.collect_list(F.struct("rn", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "part_sku"))).alias("cells"),
        F.sum("quantity").alias("page_quantity"),
        F.sum("l_suppkey").alias("page_sum"),
    )
    inside = Window.partitionBy("o_orderkey")
    key = F.col("o_orderkey")
    # a batch keeps the partitions that its pages are numbered in
    heads = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("batch_id"), "o_orderdate")
    every = heads.join(of_pages, "o_orderkey", "left").withColumn("page_no", F.coalesce("page_no", F.lit(0)))
    last = F.col("page_no") == F.max("page_no").over(inside)
    printed = F.coalesce(F.sum("page_quantity").over(inside), F.lit(0)) + F.when(key % 17 == 0, 1).otherwise(0)
    total = F.struct(
        F.when(last & (key % 19 != 0), printed).cast("bigint").alias("quantity"),
        F.when(last & (key % 29 != 0), F.sum("page_sum").over(inside)).cast("bigint").alias("sum"),
    )
    bare = F.transform("cells", lambda c: c.dropFields("rn"))
    return every.select("batch_id", "o_orderkey", "page_no", "o_orderdate", total.alias("totals"), bare.alias("cells"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several readings of one field per order: key, variant, text, confidence."""
    order = Window.partitionBy("l_orderkey").orderBy(*_ROW_ORDER)
    text = F.when(F.col("l_suppkey") % 6 == 0, F.lit(None).cast("string")).when(F.col("l_suppkey") % 6 == 1, "").otherwise((F.col("l_partkey") % 3).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.row_number().over(order).alias("variant"), text.alias("text"), (F.col("l_tax") * 100).alias("confidence")
    )

