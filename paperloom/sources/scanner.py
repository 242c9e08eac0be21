"""A landing folder in place of a scanning device.

Device control is not part of an analytics engine; a scan job writes its pages
as ``page_%03d`` files to a folder, and this gives them as a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import exists, list_images

MAX_PAGES = 200


class ScanError(RuntimeError):
    """code: NO_PAGES, TOO_MANY_PAGES or SCAN_FAILED."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def scan_batch(spark: SparkSession, folder: str, batch_id: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """The pages of a folder; more than ``max_pages`` are an error, never left out."""
    if not exists(spark, folder):
        raise ScanError("SCAN_FAILED", f"no such folder: {folder}")
    pages = list_images(spark, folder, batch_id)
    found = pages.select("path").limit(int(max_pages) + 1).count()
    if found == 0:
        raise ScanError("NO_PAGES", f"no images in {folder}")
    if found > max_pages:
        raise ScanError("TOO_MANY_PAGES", f"more than {max_pages} pages in {folder}")
    return pages
