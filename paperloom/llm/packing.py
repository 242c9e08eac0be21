"""Operator 9: packing into fixed windows by minimum bin slack.

A document is its ids and an end id.  Each full window of a document is a
sequence of its own; what remains (fewer ids than a window) is packed in blocks
of documents.  For each sequence the longest remaining piece is taken and a
subset-sum over a bitset of reachable sums finds the multiset of remaining
lengths that fills the window closest to capacity; walking the bitsets back
gives how many pieces of each length it uses, and the same multiset is repeated
while its lengths last.  A multiset that leaves slack is put aside; those put
aside are joined end to end and cut at window bounds, and the last partial
window is cut into powers of two, which need no padding.

One pass over the documents without a shuffle: a task tokenises and packs one
block of at most ``BLOCK_TOKENS`` (and one slice of documents) at a time, so memory does
not grow with partitions; numbering needs only one total per partition.

Edge cases: a null or empty text is the end id alone; null and repeated ids of
documents are rows like others; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import token_kernel
from .common import id_text, read_table, scratch, tidy, writing

WINDOW = 2048
END_ID = 1
#: Ids that are packed together; more would hardly leave fewer cuts.
BLOCK_TOKENS = 8_000_000
#: Pieces that are handed on at once.
PIECES_AT_ONCE = 500

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("part_sequence", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def fill(present: list[int], counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The best sum of at most ``room`` and how often it uses each length.

    ``present``: the lengths with a positive count, ascending.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for at in range(bisect_right(present, room) - 1, -1, -1):
        length = present[at]
        left, copies = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... copies make every number of them
            copies = min(copies, left)
            wider = (reach | reach << (length * copies)) & mask
            if wider != reach:
                steps.append((length, copies, reach))
                reach = wider
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    best = at_sum = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, copies, before in reversed(steps):
        if not before >> at_sum & 1:
            used[length] += copies
            at_sum -= length * copies
    return best, dict(used)


def pack(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start within it, length); pieces are list places.

    Every length is from 1 to ``window``.
    """
    places: dict[int, list[int]] = defaultdict(list)
    for place, length in enumerate(lengths):
        places[length].append(place)
    counts = {length: len(p) for length, p in places.items()}
    present = sorted(counts)
    sequences, aside = [], []
    while present:
        longest = present[-1]
        counts[longest] -= 1
        if not counts[longest]:
            present.pop()
        best, used = fill(present, counts, window - longest)
        counts[longest] += 1
        if counts[longest] == 1:
            insort(present, longest)
        used[longest] = used.get(longest, 0) + 1
        exact = longest + best == window
        times = min(counts[length] // n for length, n in used.items()) if exact else 1
        for _ in range(times):
            chosen = [(places[length].pop(), 0, length) for length in sorted(used, reverse=True) for _ in range(used[length])]
            if exact:
                sequences.append(chosen)
            else:
                aside.extend(chosen)
        for length, n in used.items():
            counts[length] -= n * times
            if not counts[length]:
                present.pop(bisect_right(present, length) - 1)
    return sequences + cut(aside, window)


def cut(pieces: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Joins pieces end to end; cuts at windows, and the rest at powers of two."""
    total = sum(length for _, _, length in pieces)
    sizes = [window] * (total // window) + [1 << b for b in range(window.bit_length(), -1, -1) if (total % window) >> b & 1]
    sequences: list[list[tuple[int, int, int]]] = []
    queue = iter(pieces)
    place, start, left = 0, 0, 0
    for size in sizes:
        sequence = []
        while size:
            if not left:
                place, start, left = next(queue)
            taken = min(size, left)
            sequence.append((place, start, taken))
            start, left, size = start + taken, left - taken, size - taken
        sequences.append(sequence)
    return sequences


class _Block:
    """Documents that are packed together: their ids as they were encoded, some documents after the other."""

    def __init__(self):
        self.heads, self.ids, self.n, self.tokens = [], [], [], 0

    def add(self, batch: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray) -> None:
        self.heads.append(batch.select([0, 1]))
        self.ids.append(ids)
        self.n.append(np.diff(ends))
        self.tokens += len(ids)

    def pieces(self, window: int, sequence: int) -> tuple[np.ndarray, ...]:
        """place of the document, start, length, sequence, offset of each piece."""
        n = np.concatenate(self.n)
        full = n // window
        place = np.repeat(np.arange(len(n)), full)
        start = (np.arange(len(place)) - np.repeat(np.cumsum(full) - full, full)) * window
        numbers = np.arange(sequence, sequence + len(place))
        rests, rows = np.flatnonzero(n % window), []
        for number, filled in enumerate(pack((n % window)[rests].tolist(), window), sequence + len(place)):
            offset = 0
            for at, low, length in filled:
                rows.append((at, low, length, number, offset))
                offset += length
        at, low, *others = np.array(rows, np.int64).reshape(-1, 5).T
        whole = (place, start, np.full_like(place, window), numbers, np.zeros_like(place))
        cut_up = (rests[at], (full * window)[rests[at]] + low, *others)
        return tuple(map(np.concatenate, zip(whole, cut_up, strict=True)))

    def packed(self, window: int, sequence: int) -> Iterator[pa.RecordBatch]:
        """The pieces in the order of their sequences, which are numbered from ``sequence`` on."""
        if not self.n:
            return
        n, heads = np.concatenate(self.n), pa.Table.from_batches(self.heads)
        held_by = np.repeat(np.arange(len(self.n)), [len(x) for x in self.n])
        begin = np.concatenate([np.cumsum(x) - x for x in self.n])
        every = self.pieces(window, sequence)
        for low in range(0, len(every[0]), PIECES_AT_ONCE):
            place, start, length, numbers, offset = (x[low : low + PIECES_AT_ONCE] for x in every)
            first = begin[place] + start
            spans = zip(held_by[place].tolist(), first.tolist(), (first + length).tolist(), strict=True)
            ids = pa.array([self.ids[k][a:b].tobytes() for k, a, b in spans], pa.binary())
            head = heads.take(pa.array(place)).combine_chunks()
            columns = [head.column(0).chunk(0), head.column(1).chunk(0), *map(pa.array, (start, length, n[place], numbers, offset)), ids]
            yield pa.RecordBatch.from_arrays(columns, names=PIECES.names)


def _pack_partition(path: str, end_id: int, window: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, sequence = token_kernel.encoder(path).encode_ended, _Block(), 0
        for whole in batches:
            for batch, texts in token_kernel.slices(whole, 2):
                block.add(batch, *encode(texts, end_id))
                if block.tokens >= block_tokens:
                    for rows in block.packed(window, sequence):
                        yield rows
                        sequence = rows.column(5)[-1].as_py() + 1
                    block = _Block()
        yield from block.packed(window, sequence)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    window: int = WINDOW,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (packed uint32)."""
    spark = docs.sparkSession
    numbered = id_text(docs).select("doc_id", F.spark_partition_id().alias("part"), "text")
    run = _pack_partition(tokenizer or token_kernel.default_path(), end_id, window, block_tokens)
    path = scratch(spark, "packed")
    with writing(spark):
        numbered.mapInArrow(tidy(run), PIECES).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(PIECES).parquet(path)
    # one row per partition: its sequences come after those of all before it
    totals = pieces.groupBy("part").agg((F.max("part_sequence") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(F.broadcast(bases), "part").select(
        "doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("part_sequence")).alias("sequence_id"), "offset", "ids"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
