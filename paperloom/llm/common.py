"""What the operators of this subpackage share: storage and column handling."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as in the contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A local folder is made only where ``spark.checkpoint.dir`` is unset and the
    master is local, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return Path("/tmp/checkpoints").absolute().as_uri()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch path that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Settings of every query that ends in a written table.
_WRITING = {
    # removes the shuffle files of a query when it ends; its table is written by then
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Arrow batches are bounded by bytes, as a row may hold a whole text or vector
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Within it, tables are written under ``_WRITING``."""
    before = {key: spark.conf.get(key) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts the lineage."""
    spark = df.sparkSession
    path = path or scratch(spark, label)
    with writing(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Shelf:
    """Intermediate tables in the shared folder, removed when their successors are written."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._held: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch(self._spark, label)
        table = stored(df, label, path)
        self._held.append((table, path))
        return table

    def put_parts(self, df: DataFrame, label: str, by: str, values: range) -> list[DataFrame]:
        """One table for each value of a column, written at once; each can be dropped on its own."""
        path = scratch(self._spark, label)
        with writing(self._spark):
            df.write.partitionBy(by).parquet(path)
        whole = self._spark.read.schema(df.schema).parquet(path)
        tables = [whole.where(F.col(by) == value).drop(by) for value in values]
        self._held += [(table, f"{path}/{by}={value}") for table, value in zip(tables, values, strict=True)]
        return tables

    def drop(self, *tables: DataFrame) -> None:
        """Nothing may read these tables (as ``put`` returned them) any more."""
        for table in tables:
            for held in [h for h in self._held if h[0] is table]:
                self._held.remove(held)
                discard(self._spark, held[1])

    def clear(self) -> None:
        """Nothing may read any of the tables any more."""
        self.drop(*(table for table, _ in self._held))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text; other columns never matter."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Whole rows through an Arrow function that finds columns by place: they may have any name."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def release() -> None:
    """Gives freed memory of this process back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """An Arrow function whose worker gives freed memory back when a task ends.

    Python workers outlive stages, and the allocator would keep the peak of each.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
