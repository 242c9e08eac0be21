"""One PDF for each document, written by the tasks that hold its pages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..image.encode import encode_pdf

_WRITTEN = "batch_id string, doc_seq long, pdf_path string, n_pages int, n_bytes long"


def _place(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if urlparse(root).scheme else f"file://{root}")


def write_pdfs(pages: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Writes the PDFs that ``manifest(batch_id, doc_seq, pdf_path)`` names below ``root``.

    ``pages(batch_id, doc_seq, page_index, archive)``: pages without an image are
    left out, documents without any get no file.  A document is a part of one scan
    batch, whose length the scanner bounds.  A file is written beside its place and
    then moved there, so readers see whole files and a repeated task replaces its own.
    The result has a row for each file once it is computed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(root)
        rows = (row for batch in batches for row in batch.to_pylist())
        for (batch_id, doc_seq, path), found in groupby(rows, lambda r: (r["batch_id"], r["doc_seq"], r["pdf_path"])):
            images = [r["archive"] for r in found]
            data, target = encode_pdf(images), f"{base}/{path}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            beside = f"{target}.{uuid.uuid4().hex}"
            with system.open_output_stream(beside) as out:
                out.write(data)
            system.move(beside, target)
            row = {"batch_id": batch_id, "doc_seq": doc_seq, "pdf_path": path, "n_pages": len(images), "n_bytes": len(data)}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("batch_id", pa.string()), ("doc_seq", pa.int64()), ("pdf_path", pa.string()), ("n_pages", pa.int32()), ("n_bytes", pa.int64())])
    keys = ["batch_id", "doc_seq"]
    named = pages.where("archive IS NOT NULL").join(manifest.select(*keys, "pdf_path"), keys)
    dealt = named.select(F.col("batch_id").cast("string").alias("batch_id"), F.col("doc_seq").cast("long").alias("doc_seq"), "pdf_path", "page_index", "archive")
    return dealt.repartition("batch_id", "doc_seq").sortWithinPartitions("batch_id", "doc_seq", "page_index").mapInArrow(run, _WRITTEN)
