"""Agreement of several readings of one field.

Ties go to the reading that was seen first, so ``mode`` does not serve.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tally(values: Column) -> Column:
    """STRUCT<n, value>: the most frequent of an array without nulls, the first seen among equals."""

    def better(best: Column, value: Column) -> Column:
        n = F.size(F.filter(values, lambda v: v == value))
        return F.when(n > best["n"], F.struct(n.alias("n"), value.alias("value"))).otherwise(best)

    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("value"))
    return F.aggregate(values, none, better)


def vote(values: Column) -> Column:
    """The most frequent non-null of an array, the first seen among equals."""
    return let(F.filter(values, lambda v: v.isNotNull()), lambda present: _tally(present)["value"])


def vote_readings(texts: Column) -> Column:
    """STRUCT<text, agreement> of the readings of one crop: null text if the winner is empty.

    Agreement is the winner's share of all readings, 0 without any.
    """

    def shown(present: Column) -> Column:
        def of(won: Column) -> Column:
            share = F.when(F.size(present) > 0, won["n"] / F.size(present)).otherwise(0.0)
            return F.struct(F.when(won["value"] != "", won["value"]).alias("text"), share.alias("agreement"))

        return let(_tally(present), of)

    return let(F.filter(texts, lambda t: t.isNotNull()), shown)


def read_voted(readings: DataFrame, key: str = "key") -> DataFrame:
    """Vote over ``readings(key, variant, text, confidence)``.

    text: the plurality of exact texts, by first variant among equals, null if
    empty; confidence: the greatest of the winner; agreement: its share of all
    readings that are not null.  Combines by (key, text) before it moves rows.
    """
    read = readings.where("text is not null")
    counted = read.groupBy(key, "text").agg(
        F.count(F.lit(1)).alias("n"), F.min("variant").alias("first"), F.max("confidence").alias("confidence")
    )
    order = F.struct(F.col("n"), -F.col("first"))
    won = counted.groupBy(key).agg(
        F.max_by(F.struct("text", "confidence", "n"), order).alias("w"), F.sum("n").alias("reads")
    )
    return won.select(
        key,
        F.when(F.col("w.text") != "", F.col("w.text")).alias("text"),
        F.col("w.confidence").alias("confidence"),
        (F.col("w.n") / F.col("reads")).alias("agreement"),
    )
