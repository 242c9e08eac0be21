"""Operator 6: size-partitioned MinHash containment search for test items.

Items are sets of distinct 5-word shingles, partitioned by size (powers of
two).  An item's sketch is its k least shingle hashes, k = n - ceil(0.75 n) + 1:
a document that contains three quarters of the item must contain one of them,
so the search misses nothing.  Documents are partitioned by size too: one of n
shingles is probed only with sketches of items that need n or fewer, however
long the document, and every probe is a search in one sorted array.  Retrieved
items are verified by exact shingle containment in the whole text.

Documents never shuffle; sketches are broadcast in blocks of ``BLOCK_ITEMS``
items (the stated query set against all rows), so a large benchmark costs more
passes, not more memory.

Edge cases: null or blank texts and items have no shingles and match nothing;
one to four words are one shingle, so such an item is found only in a document
of the same words; repeated rows each match; null ids stay null; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingle_kernel
from .common import id_text, map_rows, read_table

CONTAINMENT_PERCENT = 75
#: Items whose sketches and shingles one pass broadcasts.
BLOCK_ITEMS = 20_000

LEAKS = "doc_id long, item_id long, n_shared long, n_shingles long, first_word long, last_word long"


class ItemIndex:
    """Sketches of a block of items, by the size that a document needs."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        sets = [np.unique(s) for s in shingle_kernel.shingle_strings(texts)]
        self.ids, self.sets = ids, sets
        self.need = np.array([(CONTAINMENT_PERCENT * len(s) + 99) // 100 for s in sets], np.int64)
        sketches = [s[: len(s) - n + 1] if len(s) else s for s, n in zip(sets, self.need.tolist(), strict=True)]
        values = np.concatenate(sketches) if sketches else np.zeros(0, np.uint64)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sketches])
        order = np.argsort(values, kind="stable")
        self.by_class: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.values, self.owners = values[order], owners[order]

    def _of_class(self, size_class: int) -> tuple[np.ndarray, np.ndarray]:
        if size_class not in self.by_class:
            fits = self.need[self.owners] < 1 << (size_class + 1)
            self.by_class[size_class] = self.values[fits], self.owners[fits]
        return self.by_class[size_class]

    def search(self, shingles: np.ndarray) -> list[tuple[int | None, int, int, int, int]]:
        """(item id, shared, item size, first and last word) of a document."""
        if not len(shingles):
            return []
        values, owners = self._of_class(len(shingles).bit_length() - 1)
        if not len(values):
            return []
        at = np.searchsorted(values, shingles)
        hit = np.unique(shingles[values[np.minimum(at, len(values) - 1)] == shingles])
        if not len(hit):
            return []
        low, high = np.searchsorted(values, hit), np.searchsorted(values, hit, "right")
        retrieved = {int(o) for a, b in zip(low, high, strict=True) for o in owners[a:b]}
        found = []
        for item in sorted(retrieved):
            own = self.sets[item]
            places = np.flatnonzero(own[np.minimum(np.searchsorted(own, shingles), len(own) - 1)] == shingles)
            shared = len(np.unique(shingles[places]))
            if 100 * shared >= CONTAINMENT_PERCENT * len(own):
                found.append((self.ids[item], shared, len(own), int(places[0]), int(places[-1]) + shingle_kernel.WIDTH - 1))
        return found


def _search(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for place, shingles in enumerate(shingle_kernel.shingle_texts(batch.column(1))):
                rows += [(ids[place].as_py(), *leak) for leak in index.search(shingles)]
            if rows:
                names = [f.split()[0] for f in LEAKS.split(", ")]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _indexes(items: DataFrame, item_id: str, block_items: int) -> Iterator[ItemIndex]:
    """An index of each block of the items; there is one at least."""
    queries = id_text(items, item_id).where("text is not null")
    blocks = max(1, -(-queries.count() // block_items))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("doc_id", "text").collect()
        yield ItemIndex([r[0] for r in rows], [r[1] for r in rows])


def find_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Every (document, item) with three quarters of the item in the document.

    doc_id, item_id, n_shared, n_shingles (of the item), first_word, last_word.
    """
    texts, found = id_text(docs).where("text is not null"), None
    for index in _indexes(items, item_id, block_items):
        leaks = texts.mapInArrow(_search(index), LEAKS)
        found = leaks if found is None else found.unionByName(leaks)
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows, with all their columns, that hold none of the items."""
    at = docs.columns.index("text")

    def clean(index: ItemIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not index.search(s) for s in shingle_kernel.shingle_texts(batch.column(at))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for index in _indexes(items, item_id, block_items):
        docs = map_rows(docs, clean(index))
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_shared", "n_shingles")


ORACLE_SQL = rf"""
WITH texts AS (
  SELECT doc_id, NULL::BIGINT AS item_id, false AS item, text FROM documents
  UNION ALL SELECT NULL, item_id, true, text FROM benchmark),
words AS (
  SELECT doc_id, item_id, item, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM texts WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, item_id, item, w[i : i + 4] AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) >= 1)),
sizes AS (SELECT item_id, count(*) AS n FROM shingles WHERE item GROUP BY item_id),
hits AS (
  SELECT d.doc_id, q.item_id, count(*) AS n_shared
  FROM shingles q JOIN shingles d ON q.s = d.s AND q.item AND NOT d.item GROUP BY d.doc_id, q.item_id)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_shingles
FROM hits JOIN sizes USING (item_id) WHERE 100 * n_shared >= {CONTAINMENT_PERCENT} * n
"""
