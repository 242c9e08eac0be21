"""Labelled training rows without those held out, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows, tidy

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, text, y: at most ``bound`` labelled rows, drawn by a hash of the id.

    Only the drawn labels are broadcast, so their number is bounded by ``bound``
    (and by the copies of an id, of which one label is kept).
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return id_text(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y")


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, score double")


def filtered(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows whose score is kept, with all their columns; nothing shuffles."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(score(batch.column(at)))))

    return map_rows(docs, tidy(run))
