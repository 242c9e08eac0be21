"""Layout logic that relational plans express: runs, peaks, columns, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Places of the columns relative to the description column.
COLUMN_STEPS = {"description": 0, "barcode": 1, "price": 2, "quantity": 3, "sum": 4, "sku": -1, "row_number": -2}
# Paddings in pixels around a cell's crop (left/top inwards).
CELL_PAD_X, CELL_PAD_Y, LEAST_SIDE = 4, 3, 4


def merge_peaks(peaks: DataFrame, gap: int, by: str = "line") -> DataFrame:
    """The densest of each cluster of ``peaks(by, y, density)``, first on ties.

    Neighbours at most ``gap`` apart are one cluster (gaps and islands).
    """
    order = Window.partitionBy(by).orderBy("y", "density")
    opens = F.when(F.col("y") - F.lag("y").over(order) <= gap, 0).otherwise(1)
    clustered = peaks.withColumn("_opens", opens).withColumn(
        "_cluster", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    best = F.max_by(F.struct("y", "density"), F.struct(F.col("density"), -F.col("y")))
    return clustered.groupBy(by, "_cluster").agg(best.alias("b")).select(by, "b.y", "b.density")


def longest_run(bands: DataFrame, by: str = "page") -> DataFrame:
    """The longest run of usable ``bands(by, band, usable)``, first on ties."""
    order = Window.partitionBy(by).orderBy("band")
    breaks = F.sum(F.when(F.col("usable"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = bands.withColumn("_run", breaks).where("usable").groupBy(by, "_run")
    sized = runs.agg(F.min("band").alias("first_band"), F.count(F.lit(1)).alias("n_bands"))
    best = F.max_by(F.struct("first_band", "n_bands"), F.struct(F.col("n_bands"), -F.col("first_band")))
    return sized.groupBy(by).agg(best.alias("b")).select(by, "b.first_band", "b.n_bands")


def widths(edges: Column) -> Column:
    """Column widths of N + 1 ascending edges."""
    return F.transform(F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0))), lambda e, i: e - F.get(edges, i))


def resolve_columns(edges: Column) -> Column:
    """STRUCT of column numbers; the widest column is the description.

    Numbers out of range are null; null as a whole under three columns or
    without a barcode column.
    """
    wide = widths(edges)
    n = F.size(wide)
    at = (F.array_position(wide, F.array_max(wide)) - 1).cast("int")
    fields = [F.when((at + step >= 0) & (at + step < n), (at + step).cast("int")).alias(name) for name, step in COLUMN_STEPS.items()]
    return F.when((n >= 3) & (at + 1 < n), F.struct(*fields))


def columns_around(barcode: Column, n: Column) -> Column:
    """STRUCT of column numbers around the barcodes' one, null where out of range; null as a whole without it."""
    fields = []
    for name in ("row_number", "sku", "description", "barcode", "price", "quantity", "sum"):
        at = barcode - COLUMN_STEPS["barcode"] + COLUMN_STEPS[name]
        fields.append(F.when((at >= 0) & (at < n), at.cast("int")).alias(name))
    return F.when(barcode.isNotNull(), F.struct(*fields))


def probed_column(edges: Column, decoded: Column) -> Column:
    """The column with the barcodes: the first candidate among those where probes ``decoded``, else the named one.

    ``decoded``: the numbers of the columns that gave a barcode in any probed band.
    """
    named, n = resolve_columns(edges)["barcode"], F.size(widths(edges))
    hits = F.filter(barcode_candidates(named, n), lambda c: F.array_contains(decoded, c))
    return F.coalesce(F.get(hits, F.lit(0)), named)


def barcode_candidates(place: Column, n: Column) -> Column:
    """Column numbers to probe for barcodes: p, p+1, p-1, p+2, p-2 in range."""
    return F.filter(F.array(*[place + d for d in (0, 1, -1, 2, -2)]), lambda c: (c >= 0) & (c < n))


def upper_median(values: Column) -> Column:
    """The element after the lower half of the sorted array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def similarity(a: Column, b: Column, tolerance: float) -> Column:
    """Share of a's lines that have a line of b within the tolerance."""
    matched = F.size(F.filter(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= tolerance)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(matched / F.greatest(F.size(a), F.size(b)))


def cell_box(left: Column, top: Column, right: Column, bottom: Column, pad_x: int = CELL_PAD_X, pad_y: int = CELL_PAD_Y) -> Column:
    """STRUCT<x, y, width, height> of a cell inside its lines."""
    return F.struct(
        (left + pad_x).cast("int").alias("x"),
        (top + pad_y).cast("int").alias("y"),
        F.greatest(F.lit(LEAST_SIDE), right - left - 2 * pad_x).cast("int").alias("width"),
        F.greatest(F.lit(LEAST_SIDE), bottom - top - 2 * pad_y).cast("int").alias("height"),
    )


def otsu(histogram: DataFrame) -> DataFrame:
    """threshold of ``histogram(bucket, n)``: greatest between-class variance.

    At most 256 buckets reach the one ordered window.
    """
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    below, weight = F.sum("n").over(order), F.sum("n").over(everything)
    first, mass = F.sum(F.col("n") * F.col("bucket")).over(order), F.sum(F.col("n") * F.col("bucket")).over(everything)
    sums = histogram.select("bucket", below.alias("w0"), (weight - below).alias("w1"), first.alias("s0"), (mass - first).alias("s1")).where("w1 > 0")
    apart = F.col("s0").cast("double") / F.col("w0") - F.col("s1").cast("double") / F.col("w1")
    between = F.col("w0").cast("double") * F.col("w1").cast("double") * apart * apart
    return sums.agg(F.max_by("bucket", F.struct(between, -F.col("bucket"))).cast("int").alias("threshold"))
