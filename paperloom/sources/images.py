"""Page images of any format that Spark's image source reads, with their resolution.

Pixels come from the ``image`` source (BMP, PNG, JPEG, TIFF); it drops the
resolution, which is read from the first bytes of the same files.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..streaming.batches import IMAGE_FILES

METRES_PER_INCH = 0.0254
#: Bytes of a file that are searched for its resolution.
HEAD_BYTES = 1 << 16


def _png_dpi(head: bytes) -> float | None:
    at = 8
    while at + 8 <= len(head):
        (size,), kind = struct.unpack_from(">I", head, at), head[at + 4 : at + 8]
        if kind == b"pHYs" and at + 17 <= len(head):
            ppm, _, unit = struct.unpack_from(">IIB", head, at + 8)
            return ppm * METRES_PER_INCH if unit == 1 else None
        if kind in (b"IDAT", b"IEND"):
            return None
        at += 12 + size
    return None


def _tiff_dpi(head: bytes) -> float | None:
    order = "<" if head[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", head, 4)
    (n,) = struct.unpack_from(order + "H", head, at)
    across, unit = None, 2
    for k in range(n):
        tag, kind, _, value = struct.unpack_from(order + "HHII", head, at + 2 + 12 * k)
        if tag == 282 and kind == 5:
            top, bottom = struct.unpack_from(order + "II", head, value)
            across = top / bottom if bottom else None
        elif tag == 296:
            unit = struct.unpack_from(order + "H", head, at + 2 + 12 * k + 8)[0]
    return None if across is None or unit == 1 else across * (2.54 if unit == 3 else 1)


def _jpeg_dpi(head: bytes) -> float | None:
    at = 2
    while at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] != 0xDA:
        (size,) = struct.unpack_from(">H", head, at + 2)
        body = head[at + 4 : at + 2 + size]
        if head[at + 1] == 0xE0 and body[:5] == b"JFIF\0":
            unit, across = struct.unpack_from(">BH", body, 7)
            if unit in (1, 2):
                return across * (2.54 if unit == 2 else 1)
        if head[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            return _tiff_dpi(body[6:])
        at += 2 + size
    return None


def dpi_of(head: bytes) -> int | None:
    """The resolution that a file's first bytes tell; None where there is none or they are broken."""
    try:
        if head[:2] == b"BM":
            found = struct.unpack_from("<i", head, 38)[0] * METRES_PER_INCH
        elif head[:8] == b"\x89PNG\r\n\x1a\n":
            found = _png_dpi(head)
        elif head[:2] == b"\xff\xd8":
            found = _jpeg_dpi(head)
        elif head[:4] in (b"II*\0", b"MM\0*"):
            found = _tiff_dpi(head)
        else:
            found = None
    except struct.error:
        return None
    return round(found) if found and found > 0 else None


@F.pandas_udf(IntegerType())
def _dpi(heads: pd.Series) -> pd.Series:
    return heads.map(lambda h: dpi_of(bytes(h))).astype("Int32")


def _same_path(path: Column) -> Column:
    """Both sources name local files, with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+\z", 1)


def load_images(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """path, dpi, image of image files or folders.

    A file that cannot be decoded is an error, as its page would be lost without a trace.
    """
    deep = str(recursive).lower()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", deep).load(paths).where(F.col("path").rlike(IMAGE_FILES))
    heads = files.select(_same_path(F.col("path")).alias("path"), _dpi(F.substring("content", 1, HEAD_BYTES)).alias("dpi"))
    found = spark.read.format("image").option("recursiveFileLookup", deep).load(paths)
    # Spark gives what it could not decode a height of -1, or leaves it out
    pixels = found.select(_same_path(F.col("image.origin")).alias("path"), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image"))
    readable = F.coalesce(F.col("image.height") > 0, F.lit(False))
    failed = F.raise_error(F.concat(F.lit("not a readable image: "), F.col("path"))).cast("string")
    return heads.join(pixels, "path", "left").select(F.when(readable, F.col("path")).otherwise(failed).alias("path"), "dpi", "image")


def read_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """batch_id, page_index, path, dpi, image of a folder's image files, or one file's.

    A folder is a batch and gives it its name; pages are numbered in binary order
    of their paths, by batch, so only paths are shuffled for it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    listed = files.where(F.col("path").rlike(IMAGE_FILES)).select(_same_path(F.col("path")).alias("path"))
    order = Window.partitionBy("batch_id").orderBy("path")
    numbered = listed.withColumn("batch_id", parent(F.col("path"))).withColumn("page_index", F.row_number().over(order) - 1)
    return numbered.join(load_images(spark, path, recursive), "path").select("batch_id", "page_index", "path", "dpi", "image")
