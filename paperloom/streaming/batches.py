"""Files that arrive close together form one batch.

A batch closes when nothing arrived for the quiet period; a gap of exactly the
period still belongs.  The same expression serves tables and streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the hot folder.
QUIET = "4 seconds"
IMAGE_FILES = r"(?i)\.(bmp|png|jpe?g|tiff?)$"
_FILES = "path string, modificationTime timestamp, length long, content binary"


def quiet_batches(arrivals: DataFrame, quiet: str = QUIET, *by: str) -> DataFrame:
    """One row per batch of ``arrivals(ts, ...)``: n_files, first_ts, last_ts."""
    session = F.session_window("ts", quiet)
    sums = [F.count(F.lit(1)).alias("n_files"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    if "path" in arrivals.columns:
        sums.append(F.sort_array(F.collect_list("path")).alias("paths"))
    return arrivals.groupBy(session, *by).agg(*sums).drop("session_window")


def hot_folder(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """A stream of image files: path, ts, length, content.

    Without ``max_files`` a micro-batch takes all files that are there, so a batch
    of many pages is not cut in two.

    Existing files are read too.  Writers should rename complete files into the
    folder; a rename is atomic, so half-written files are never seen.
    """
    files = spark.readStream.schema(_FILES).format("binaryFile").option("recursiveFileLookup", "false")
    if max_files is not None:
        files = files.option("maxFilesPerTrigger", max_files)
    found = files.load(folder).where(F.col("path").rlike(IMAGE_FILES))
    return found.select("path", F.col("modificationTime").alias("ts"), "length", "content")
