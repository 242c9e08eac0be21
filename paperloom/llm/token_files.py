"""Operator 4: token ids in ORC files, for stripe-parallel reads.

``write_token_files`` range-partitions the documents by id, encodes each whole
text with a public ``tokenizers`` file, ends it with an end id and writes one
sorted ORC file per partition: integers are run-length encoded, every stripe
has row indexes, and ids of documents have Bloom filters, so a reader prunes
files, stripes and row groups by id and splits a file between tasks by stripe.
``read_token_files`` reads the files back; ``token_digest`` derives per
document its place in the whole sequence and a checksum of its ids.

Edge cases: a null or empty text is the end id alone; null ids of documents
come first; repeated ids each keep a row (their order among themselves is that
of the texts); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import token_kernel
from .common import id_text, read_table, scratch, tidy, writing

END_ID = 2
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000

FILE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)


def _encode_partition(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = token_kernel.encoder(path).encode_ended, 0
        for whole in batches:
            for batch, texts in token_kernel.slices(whole, 2):
                flat, ends = encode(texts, end_id)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(at + ends[:-1]), pa.array(np.diff(ends)), ids],
                    names=FILE_SCHEMA.names,
                )
                at += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Encodes ``docs(doc_id, text)`` into ORC files below ``path``."""
    ranged = id_text(docs).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = ordered.select("doc_id", F.spark_partition_id().alias("part"), "text")
    encoded = numbered.mapInArrow(tidy(_encode_partition(tokenizer or token_kernel.default_path(), end_id)), FILE_SCHEMA)
    with writing(docs.sparkSession):
        (
            encoded.write.mode("overwrite")
            .option("orc.compress", "ZSTD")
            .option("orc.stripe.size", STRIPE_BYTES)
            .option("orc.row.index.stride", ROW_INDEX_STRIDE)
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", "0.01")
            .orc(path)
        )
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, part_start, n_tokens, ids: one row per document."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B")
        at = (ids.offsets.to_numpy() * 4).tolist()
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
        n = np.diff(ids.offsets.to_numpy()).astype("i8")
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(n), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files."""
    files = read_token_files(spark, path)
    # one row per file: its ids come after those of all files before it
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    summed = files.select("doc_id", "part", "part_start", "ids").mapInArrow(
        _checksums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"
    )
    return summed.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("file_start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(read_table(spark, sf_dir, "documents"), scratch(spark, "token-files"))
    return token_digest(spark, path)
