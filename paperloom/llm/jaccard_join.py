"""Operator 1: n-gram Jaccard self-join with count vectors in R-trees.

A document is the set of its distinct 5-word shingles; two link when their
Jaccard similarity is 0.75 or more.  Every link between different sets counts,
none is sampled or capped:

1. Each set is sketched once: its size, a 128-bit digest, the vector of how
   many of its shingles fall into each hash group, and its prefix (see 3).
2. Equal sets become one node, so copies never make pairs.
3. Sets that link share a shingle among the first n - ceil(0.75 n) + 1 of a
   common order (frequent shingles last, else by hash), and e more of them if the
   prefix is e longer.  A prefix shingle that several nodes share belongs to the
   least of them, its anchor, and all nodes that share a shingle of an anchor
   form one R-tree over their count vectors.  So a group of near copies makes a
   few trees, not one for each shingle it shares.  Prefixes are 0.1 n longer, and
   a node leaves its largest trees while they hold no more shingles of it than
   a link has to spare (see ``_least_trees``): documents that share only a
   passage mostly are in no tree.  One R-tree over all documents would prune
   little: counts of a random hash are near-equal in all dimensions, so its
   boxes overlap.
4. Stars: each point of a tree is bounded against the tree's anchor alone, by
   summed coordinate minima; pairs below 3/7 (n1 + n2) cannot link.  What is
   left is verified on the exact sets and contracted, which folds a group of
   thousands of near copies with about as many comparisons as members.  In
   further rounds, if asked for, nodes that stay alone get a drawn leader.
5. The rest is exact.  The stars decided all pairs with an anchor, so anchors
   leave their trees.  In every tree that then holds several components, boxes of
   points are joined with boxes whose sizes fit and whose greatest counts have
   large enough summed minima, then their points.  Points travel with counts cut
   off at one (a bit a group); what is cut off is known from the size, and bounds
   allow for it.  Surviving pairs are bounded again with counts up to three.
   Those of different components are verified; of a tree with too many pairs,
   first each node's likeliest partner alone, round after round while that folds
   much (components at least halve where the picks hold), then all pairs of
   components that are still apart.

Large trees are split into blocks of like sizes, and only pairs of blocks whose
sizes can link, and that are not both of the tree's largest component, are dealt
out.  Sets never travel: pairs are verified on texts, which are shingled where a
pair meets, one leader after the other.

Edge cases: null or blank texts have an empty set and link with nothing; one
to four words are one shingle; null ids are rows like others (a component's id
is its least non-null id); repeated rows share a component; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shingle_kernel
from .common import Shelf, id_text, read_table, tidy, writing
from .graph import components

THRESHOLD_PERCENT = 75
#: Hash groups of a count vector: a power of two, GROUPS_EACH or more a shingle.
#: Sparse groups bound overlaps tightly: documents that share half their shingles
#: and nothing else pass no bound.  Finer vectors fold into coarser ones by
#: summing neighbours.
LEAST_GROUPS, MOST_GROUPS, GROUPS_EACH = 256, 1 << 15, 4
#: Rounds of stars: the first under the anchors, any others under drawn leaders.
STAR_ROUNDS = 1
#: Members that one copy of a leader's set serves; larger stars are split.
STAR_MEMBERS = 512
#: Pairs a node that a tree may send at once; a tree with more sends the likeliest.
TREE_PAIRS = 8
#: Links that make another round of likeliest partners worth its jobs.
ROUND_LINKS = 500
#: Shingles in at least this share of documents come last in the common order.
FREQUENT_SHARE = 0.002
#: Nodes of one R-tree that a task holds; larger trees are split into blocks.
BLOCK_NODES = 1024
#: Trees of so few nodes are compared in bulk; larger ones have boxes of BOX points.
LEAF, BOX = 16, 64
#: Nodes of small trees that share a home, and so travel once; more are sent by tree.
HOME_NODES = 1 << 15
#: Size of the bitmap that keeps most texts from moving for verification.
FILTER_BITS = 24
#: Counts of vectors that are unpacked and compared at once.
BOUND_CELLS = 1 << 20

#: Shingles that prefixes hold beyond those they need, of a set's size.
SPARE_PERCENT = 10
#: Parts of the prefixes, by the shingles' low bits.  They are dealt one or several at a time, so that
#: only a part's shuffle files lie on disk: a turn for each PART_SHINGLES shingles of all sets, at most all.
PREFIX_PARTS, PART_SHINGLES = 8, 1 << 24

#: What draws the leaders of each round.
_MASKS = shingle_kernel.mix(np.arange(1, 5, dtype=np.uint64))

#: part 0: documents; parts from 1 on: node and keys, its prefix shingles of that part; the last: the frequent ones.
SKETCH = "doc_id long, node long, text_hash long, n long, digest binary, counts binary, keys array<long>, part int"
_SKETCHED = ["doc_id", "node", "text_hash", "n", "digest", "counts", "keys", "part"]


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of some documents with the number of those that have them."""
    for whole in batches:
        for low in range(0, whole.num_rows, 2048):
            batch = whole.slice(low, 2048)
            sets = [np.unique(s) for s in shingle_kernel.shingle_texts(batch.column(0))]
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n >= max(3, FREQUENT_SHARE / 2 * len(sets))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[often].view(np.int64)), pa.array(n[often].astype("i8"))], names=["shingle", "n"]
            )


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles in ``FREQUENT_SHARE`` of all documents or more, sorted.

    At most 1 / FREQUENT_SHARE times the mean set size, whatever the corpus.
    They only order shingles; results do not depend on them.
    """
    least = max(3.0, FREQUENT_SHARE * docs.count())
    counted = docs.select("text").mapInArrow(tidy(_count_frequent), "shingle long, n long")
    with writing(docs.sparkSession):
        rows = counted.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def groups_of(n: int) -> int:
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << (max(1, n * GROUPS_EACH) - 1).bit_length()))


_FOUR = np.array([[(b >> k) & 3 for k in (0, 2, 4, 6)] for b in range(256)], np.uint8)


def closed(counts: np.ndarray) -> bytes:
    """Counts of groups, two bits each, as they travel; 3 stands for 3 or more.

    What is cut off is the set's size less the sum, so bounds can allow for it.
    """
    return (np.minimum(counts, 3).reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(axis=1).astype("u1").tobytes()


def opened(packed: bytes) -> bytes:
    """One byte a group."""
    return _FOUR[np.frombuffer(packed, np.uint8)].tobytes()


def vectors(packed: list[bytes]) -> np.ndarray:
    """Equally long count vectors as rows."""
    return np.frombuffer(b"".join(packed), "u1").reshape(len(packed), -1)


def fold(counts: np.ndarray, groups: int) -> np.ndarray:
    """Vectors of fewer groups: sums of neighbours."""
    return counts.reshape(*counts.shape[:-1], groups, -1).sum(axis=-1, dtype=np.int32) if groups < counts.shape[-1] else counts


def prefix_length(size: int) -> int:
    """Sets that link share more than ``SPARE_PERCENT`` of 0.75 n shingles within their prefixes."""
    return min(size, size - (THRESHOLD_PERCENT * size + 99) // 100 + 1 + SPARE_PERCENT * size // 100)


def _prefix_rows(node: pa.Array, rare: list[np.ndarray], often: list[np.ndarray]) -> pa.RecordBatch:
    """The rows of all parts but the first."""
    values = np.concatenate([*rare, *often])
    row = np.repeat(np.tile(np.arange(len(node)), 2), [len(p) for p in (*rare, *often)])
    part = (values & np.uint64(PREFIX_PARTS - 1)).astype(np.int64)
    part[sum(len(p) for p in rare) :] = PREFIX_PARTS
    place = part * len(node) + row
    sizes = np.bincount(place)
    filled = np.flatnonzero(sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes[filled])])
    keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[np.argsort(place, kind="stable")].view(np.int64)))
    empty = {kind: pa.nulls(len(filled), kind) for kind in (pa.int64(), pa.binary())}
    return pa.RecordBatch.from_arrays(
        [
            empty[pa.int64()],
            node.take(pa.array(filled % len(node))),
            *[empty[pa.int64()]] * 2,
            *[empty[pa.binary()]] * 2,
            keys,
            pa.array(filled // len(node) + 1, pa.int32()),
        ],
        names=_SKETCHED,
    )


def _sketch(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                n, digest, counts, rare, often = [], [], [], [], []
                for shingles in shingle_kernel.shingle_texts(batch.column(3)):
                    own = np.unique(shingles)
                    size = len(own)
                    n.append(size)
                    if not size:
                        digest.append(b""), counts.append(b""), rare.append(own), often.append(own)
                        continue
                    digest.append(np.array([own.sum(), np.bitwise_xor.reduce(shingle_kernel.mix(own))]).tobytes())
                    bits = groups_of(size).bit_length() - 1
                    per_group = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                    counts.append(closed(per_group))
                    length = prefix_length(size)
                    late = own[:0]
                    if len(frequent):
                        is_late = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
                        own, late = own[~is_late], own[is_late]
                    rare.append(own[:length])
                    often.append(late[: max(0, length - len(own))])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:3],
                        pa.array(n, pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.array(counts, pa.binary()),
                        pa.nulls(len(n), pa.list_(pa.int64())),
                        pa.array(np.zeros(len(n), np.int32)),
                    ],
                    names=_SKETCHED,
                )
                yield _prefix_rows(batch.column(1), rare, often)

    return run


def sketch_documents(docs: DataFrame, shelf: Shelf) -> tuple[DataFrame, list[DataFrame]]:
    """One row per document, and the parts of the prefixes, written; ``node`` numbers the rows."""
    frequent = frequent_shingles(docs)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("node"), F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.mapInArrow(tidy(_sketch(frequent)), SKETCH)
    sketch, *prefixes = shelf.put_parts(rows, "jaccard-sketch", "part", range(PREFIX_PARTS + 2))
    return sketch, prefixes


def _bound(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of two equally long blocks of vectors."""
    return np.minimum(mine, theirs).sum(axis=-1, dtype=np.int64)


def as_bits(packed: bytes) -> bytes:
    """A travelling vector cut off at one: a bit a group, of whole words."""
    return np.packbits(np.frombuffer(opened(packed), np.uint8) > 0).tobytes()


def bit_rows(bits: list[bytes], length: int) -> np.ndarray:
    """Equally long bit vectors as rows of words, folded to ``length`` bytes."""
    rows = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    while rows.shape[1] > length:
        rows = np.packbits(np.unpackbits(rows, axis=1).reshape(len(rows), -1, 2).max(axis=2), axis=1)
    return np.ascontiguousarray(rows).view(np.uint64)


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


class BoxTree:
    """Points of one length in order of size, and boxes of BOX points each.

    A box has its least size, the most that is cut off, and its greatest counts.
    """

    def __init__(self, n: np.ndarray, words: np.ndarray):
        self.order = np.argsort(n, kind="stable")
        self.n, self.words = n[self.order], words[self.order]
        self.cut = self.n - _ones(self.words)
        self.at = np.arange(0, len(n), BOX)
        self.box_n, self.box_cut = self.n[self.at], np.maximum.reduceat(self.cut, self.at)
        self.boxes = np.bitwise_or.reduceat(self.words, self.at, axis=0)

    def points_near(self, n: np.ndarray, cut: int, box: np.ndarray) -> np.ndarray:
        """Places of the points in boxes that may hold partners of a box of sizes ``n``."""
        low, high = np.searchsorted(self.n, (3 * n[0] + 3) // 4), np.searchsorted(self.n, 4 * n[-1] // 3, "right")
        boxes = np.arange(low // BOX, -(-high // BOX)) if high > low else np.zeros(0, np.int64)
        most = _ones(self.boxes[boxes] & box) + np.minimum(self.box_cut[boxes], cut)
        boxes = boxes[7 * most >= 3 * (n[0] + self.box_n[boxes])]
        points = (boxes[:, None] * BOX + np.arange(BOX)).ravel()
        return points[(points >= low) & (points < high)]


def join_trees(one: BoxTree, other: BoxTree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both trees (as given) of pairs that may link, and by how much, box after box of the first."""
    for box, low in enumerate(one.at):
        n, cut, words = (part[low : low + BOX] for part in (one.n, one.cut, one.words))
        points = other.points_near(n, int(one.box_cut[box]), one.boxes[box])
        step = max(1, BOUND_CELLS // (len(n) * words.shape[1]))
        for first in range(0, len(points), step):
            at = points[first : first + step]
            both = _ones(words[:, None, :] & other.words[at][None, :, :]) + np.minimum(cut[:, None], other.cut[at][None, :])
            theirs = other.n[at][None, :]
            spare = 7 * both - 3 * (n[:, None] + theirs)
            x, y = np.nonzero((spare >= 0) & (4 * n[:, None] >= 3 * theirs) & (4 * theirs >= 3 * n[:, None]))
            yield one.order[low + x], other.order[at[y]], spare[x, y]


def _likeliest(owner: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Of each owner the place with the most overlap to spare."""
    order = np.lexsort((-spare, owner))
    first = np.ones(len(order), bool)
    first[1:] = owner[order][1:] != owner[order][:-1]
    return order[first]


def tree_pairs(
    node: np.ndarray, comp: np.ndarray, n: np.ndarray, packed: list[bytes], side: np.ndarray, best: bool = False
) -> list[tuple[int, int]]:
    """Pairs of different components that the count vectors let link.

    ``best``: of each node, only the likeliest partner.

    ``side``: 0 for a tree's own nodes alone; 1 and 2 for two blocks that are
    compared with each other only.
    """
    if len(node) < 2 or (comp == comp[0]).all():
        return []
    split = bool((side == 2).any())
    groups = [np.flatnonzero(side == 1), np.flatnonzero(side == 2)] if split else [np.arange(len(node))] * 2
    if not len(groups[0]) or not len(groups[1]):
        return []
    lengths, trees, ones, others, spares = np.array([len(p) for p in packed]), {}, [], [], []

    def tree(turn: int, own: int, folded: int) -> tuple[BoxTree, np.ndarray]:
        key = (turn if split else 0, own, folded)
        if key not in trees:
            at = groups[turn][lengths[groups[turn]] == own]
            trees[key] = BoxTree(n[at], bit_rows([packed[k] for k in at], folded)), at
        return trees[key]

    kinds = [np.unique(lengths[g]).tolist() for g in groups]
    for own in kinds[0]:
        for theirs in kinds[1]:
            # sizes that link differ by a third at most
            if own > 2 * theirs or theirs > 2 * own or (not split and own < theirs):
                continue
            (left, at), (right, to) = tree(0, own, min(own, theirs)), tree(1, theirs, min(own, theirs))
            for x, y, spare in join_trees(left, right):
                x, y = at[x], to[y]
                apart = comp[x] != comp[y]
                if not split and own == theirs:
                    apart &= node[y] < node[x]
                ones.append(x[apart]), others.append(y[apart]), spares.append(spare[apart])
    one, other, spare = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in (ones, others, spares))
    return _chosen(node, one, other, spare, best)


def _chosen(node: np.ndarray, one: np.ndarray, other: np.ndarray, spare: np.ndarray, best: bool) -> list[tuple[int, int]]:
    """Pairs of nodes from pairs of places; with ``best`` each side's likeliest."""
    if best and len(one) > 1:
        both = np.concatenate([np.arange(len(one))] * 2)
        both = np.unique(both[_likeliest(np.concatenate([node[one], node[other]]), spare[both])])
        one, other = one[both], other[both]
    a, b = node[one], node[other]
    return list(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))


def leaf_pairs(
    tree: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, packed: list[bytes], best: bool = False
) -> list[tuple[int, int]]:
    """The same for many trees of one leaf each; rows of a tree are adjacent.

    A pair that meets in several trees is bounded once.
    """
    ones, others = [], []
    for step in range(1, LEAF):
        at = np.flatnonzero((tree[step:] == tree[:-step]) & (comp[step:] != comp[:-step]))
        if step > 1 and not len(at) and not (tree[step:] == tree[:-step]).any():
            break
        ones.append(at)
        others.append(at + step)
    one, other = np.concatenate(ones), np.concatenate(others)
    swap = node[one] > node[other]
    one, other = np.where(swap, other, one), np.where(swap, one, other)
    _, first = np.unique(np.stack([node[one], node[other]]), axis=1, return_index=True)
    one, other = one[first], other[first]
    fits = (4 * n[one] >= 3 * n[other]) & (4 * n[other] >= 3 * n[one])
    one, other = one[fits], other[fits]
    spare = _bit_spare([packed[k] for k in one], [packed[k] for k in other], n[one], n[other])
    kept = np.flatnonzero(spare >= 0)
    return _chosen(node, one[kept], other[kept], spare[kept], best)


def _by_lengths(c1: list[bytes], c2: list[bytes], cells: int) -> Iterator[tuple[np.ndarray, int]]:
    """Places of pairs of like lengths, some at a time, and the shorter length."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(c1, c2, strict=True)]).reshape(-1, 2)
    for g1, g2 in np.unique(sizes, axis=0).tolist():
        same, step = np.flatnonzero((sizes == (g1, g2)).all(axis=1)), max(16, cells // max(g1, g2))
        for low in range(0, len(same), step):
            yield same[low : low + step], min(g1, g2)


def _bit_spare(c1: list[bytes], c2: list[bytes], n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Like ``_spare`` for bit vectors."""
    spare = np.full(len(n1), -1, np.int64)
    for at, least in _by_lengths(c1, c2, 8 * BOUND_CELLS):
        one, other = (bit_rows([c[k] for k in at], least) for c in (c1, c2))
        cut = np.minimum(n1[at] - _ones(one), n2[at] - _ones(other))
        spare[at] = 7 * (_ones(one & other) + cut) - 3 * (n1[at] + n2[at])
    return spare


def _spare(c1: list[bytes], c2: list[bytes], n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """By how much each pair's bound passes what a link needs; negative: cannot link.

    ``c1`` and ``c2``: vectors as they travel.
    """
    spare = np.full(len(n1), -1, np.int64)
    for at, _ in _by_lengths(c1, c2, BOUND_CELLS // 4):
        spare[at] = _spare_of([[opened(c[k]) for k in at] for c in (c1, c2)], n1[at], n2[at])
    return spare


def _spare_of(both: list[list[bytes]], n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The same for vectors of one byte a group, of one length on each side."""
    least = min(len(both[0][0]), len(both[1][0]))
    one, other = (fold(vectors(c), least) for c in both)
    # no more is shared beyond the cut than either set has there
    cut = np.minimum(n1 - one.sum(axis=1, dtype=np.int64), n2 - other.sum(axis=1, dtype=np.int64))
    return 7 * (_bound(one, other) + cut) - 3 * (n1 + n2)


def _bounded(c1: list[bytes], c2: list[bytes], n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Whether each pair of vectors (one byte a group, of one length on each side) lets its sets link."""
    return _spare_of([c1, c2], n1, n2) >= 0


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _join_trees(batches, False)


def _join_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _join_trees(batches, True)


def _join_trees(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by the home of their trees: whole homes are held, small ones together."""

    def out(pairs: set[tuple[int, int | None]]) -> pa.RecordBatch:
        a, b = zip(*pairs, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def join(table: pa.Table, pairs: set[tuple[int, int]]) -> None:
        # a row stands for its node in each of its trees
        trees = table.column("trees").combine_chunks()
        key, row = trees.flatten().to_numpy(), np.repeat(np.arange(len(table)), pa.compute.list_value_length(trees).to_numpy())
        block = table.column("block").to_numpy()[row]
        order = np.lexsort((block, key))
        key, block, row = key[order], block[order], row[order]
        node, comp, n, side = (table.column(c).to_numpy()[row] for c in ("node", "comp", "n", "side"))
        bits = table.column("bits").to_pylist()
        packed = [bits[k] for k in row]
        starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1])
        sizes = np.diff(np.append(starts, len(key)))
        tree = np.repeat(np.arange(len(starts)), sizes)
        split = np.maximum.reduceat(side, starts) > 0
        leaf = np.flatnonzero(((sizes <= LEAF) & ~split)[tree])
        if len(leaf) > 1:
            pairs.update(leaf_pairs(tree[leaf], node[leaf], comp[leaf], n[leaf], [packed[k] for k in leaf]))
        for low, size in zip(starts[(sizes > LEAF) | split], sizes[(sizes > LEAF) | split], strict=True):
            own = slice(low, low + size)
            found = tree_pairs(node[own], comp[own], n[own], packed[own], side[own])
            if best and len(found) > TREE_PAIRS * size:  # the tree stays open: what is left out comes later
                found = [*tree_pairs(node[own], comp[own], n[own], packed[own], side[own], best=True), (int(key[low]), None)]
            pairs.update(found)

    pairs: set[tuple[int, int]] = set()
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # the last home of a batch may go on in the next
        last = int(np.flatnonzero((key != key[-1]) | (block != block[-1]))[-1]) + 1 if (key != key[-1]).any() or (block != block[-1]).any() else 0
        if held and (last or (held[-1].column(0)[-1], held[-1].column(1)[-1]) != (batch.column(0)[0], batch.column(1)[0])):
            join(pa.Table.from_batches([*held, batch.slice(0, last)]), pairs)
            held = [batch.slice(last)]
        elif last:
            join(pa.Table.from_batches([batch.slice(0, last)]), pairs)
            held = [batch.slice(last)]
        else:
            held.append(batch)
        if len(pairs) > 100_000:
            yield out(pairs)
            pairs = set()
    if held:
        join(pa.Table.from_batches(held), pairs)
    if pairs:
        yield out(pairs)


def _led(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a few rows, and which of them lead those that follow."""
    for whole in batches:
        for low in range(0, whole.num_rows, rows):
            batch = whole.slice(low, rows)
            yield batch, batch.column(2).to_numpy() == 0


def _keep_possible(spare_of):
    """Members whose sizes and vectors let them link with their leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead_n, lead = 0, b""
        for batch, leads in _led(batches, 512):
            n, own, at, theirs, sizes = batch.column(4).to_numpy(), batch.column(5).to_pylist(), [], [], []
            for place, is_lead in enumerate(leads.tolist()):
                if is_lead:
                    lead_n, lead = int(n[place]), own[place]
                elif 4 * lead_n >= 3 * n[place] and 4 * n[place] >= 3 * lead_n:
                    at.append(place), theirs.append(lead), sizes.append(lead_n)
            kept = np.array(at, np.int64)
            kept = kept[spare_of([own[k] for k in at], theirs, n[kept], np.array(sizes, np.int64)) >= 0]
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(kept)), batch.column(0).take(pa.array(kept))], names=["a", "b"])

    return run


def _to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, 512):
            batch = whole.slice(low, 512)
            bits = pa.array([as_bits(p.as_py()) for p in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits], names=["node", "n", "bits"])


def points(sketch: DataFrame) -> DataFrame:
    """node, n, bits: what the trees hold."""
    return sketch.where("n > 0").select("node", "n", "counts").mapInArrow(tidy(_to_bits), "node long, n long, bits binary")


def _keep_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members whose exact sets reach the threshold with their leader's."""
    lead = np.zeros(0, np.uint64)
    for batch, leads in _led(batches, 256):
        kept = []
        for place, shingles in enumerate(shingle_kernel.shingle_texts(batch.column(4))):
            own = np.unique(shingles)
            if leads[place]:
                lead = own
                continue
            at = np.searchsorted(lead, own)
            both = int((lead[np.minimum(at, len(lead) - 1)] == own).sum())
            if 100 * both >= THRESHOLD_PERCENT * (len(lead) + len(own) - both):
                kept.append(place)
        kept = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(3).take(kept), batch.column(0).take(kept)], names=["a", "b"])


def _dealt(pairs: DataFrame) -> DataFrame:
    """lead, part, role, node: pairs ``(a, b)`` as members ``a`` (role 1) under leaders ``b`` (role 0).

    A star of more than STAR_MEMBERS is split; each part has the leader.
    """
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR_MEMBERS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    members = pairs.join(sizes, "b").select(
        F.col("b").alias("lead"), part.alias("part"), F.lit(1).alias("role"), F.col("a").alias("node")
    )
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    leads = sizes.select(F.col("b").alias("lead"), parts.alias("part"), F.lit(0).alias("role"), F.col("b").alias("node"))
    return members.unionByName(leads)


def _by_leader(rows: DataFrame) -> DataFrame:
    return rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "role")


def _marked(rows: DataFrame, hashed: Column, places: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: false only where no place has the same hash, so most rows need not move.

    At most 2^FILTER_BITS / 64 words of a bitmap are broadcast, whatever the corpus.
    """
    bucket = F.pmod(hashed, F.lit(1 << FILTER_BITS))
    bit, word = bucket.bitwiseAND(F.lit(63)).cast("int"), F.shiftright(bucket, 6)
    set_bits = places.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    words = set_bits.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = rows.withColumn("word", word).join(F.broadcast(words), "word", "left")
    hit = F.call_function("shiftrightunsigned", "bits", bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return found.withColumn("marked", F.coalesce(hit, F.lit(False))).drop("word", "bits")


def _likely(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Texts that may be among the places."""
    return _marked(texts, F.col("text_hash"), places).where("marked").drop("marked")


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose node is not among the others; only rows that may be are joined with them."""
    told = _marked(rows, F.xxhash64("node"), others)
    unsure = told.where("marked").join(others, "node", "left_anti")
    return told.where("NOT marked").unionByName(unsure).drop("marked")


def _among(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose node may be among the others, so that most others need not move."""
    return _marked(rows, F.xxhash64("node"), others).where("marked").drop("marked")


def possible(pairs: DataFrame, sketch: DataFrame, vectors_of, spare_of, shelf: Shelf) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and vectors ``(node, n, vector)`` let link, written."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    vectors = vectors_of(_among(sketch, ends))
    rows = _by_leader(_dealt(pairs).join(vectors, "node").select("lead", "part", "role", "node", *vectors.columns[1:]))
    return shelf.put(rows.mapInArrow(tidy(_keep_possible(spare_of)), "a long, b long"), "jaccard-possible")


def verified(pairs: DataFrame, sketch: DataFrame, docs: DataFrame, shelf: Shelf) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose exact sets reach the threshold, written.

    Counts up to three rule out most pairs before any text moves.
    """
    pairs = close = possible(pairs, sketch, lambda rows: rows.select("node", "n", "counts"), _spare, shelf)
    places = sketch.select("node", F.col("doc_id").alias("its_id"), "text_hash")
    jobs = shelf.put(_dealt(pairs).join(places, "node"), "jaccard-jobs")
    texts = _likely(docs.withColumn("text_hash", F.xxhash64("text")), jobs)
    wanted = jobs.withColumnRenamed("text_hash", "its_hash")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash"))
    rows = _by_leader(texts.join(wanted, same).select("lead", "part", "role", "node", "text"))
    links = shelf.put(rows.mapInArrow(tidy(_keep_links), "a long, b long").distinct(), "jaccard-links")
    shelf.drop(jobs, close)
    return links


def tree_members(sketch: DataFrame, prefixes: list[DataFrame], repeats: DataFrame, shelf: Shelf) -> DataFrame:
    """key (the anchor's node), node: the nodes of each tree, written; prefixes are dropped.

    Prefixes are dealt in parts by shingle.  Frequent shingles may be in the
    prefixes of a third of all nodes: they are combined before they move, and
    their anchors (as many at most as there are frequent shingles) are sent to
    their rows.  Others move once.
    """
    shared = (F.min("node").alias("anchor"), F.count(F.lit(1)).alias("k"))

    def shingles(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        return _without(whole.select("node", "keys"), repeats).select("node", F.explode("keys").alias("key"))

    def met(dealt: DataFrame, send) -> DataFrame:
        anchors = send(dealt.groupBy("key").agg(*shared).where("k > 1").select("key", "anchor"))
        both = dealt.join(anchors, "key").groupBy(F.col("anchor").alias("key"), "node")
        return shelf.put(both.agg(F.count(F.lit(1)).alias("shared")), "jaccard-met")

    *rare, often = prefixes
    turns = min(len(rare), 1 + (sketch.agg(F.sum("n")).first()[0] or 0) // PART_SHINGLES)
    found = []
    for turn in range(turns):
        found.append(met(shingles(rare[turn::turns]).repartition("key"), lambda anchors: anchors))
        shelf.drop(*rare[turn::turns])
    found.append(met(shingles([often]), F.broadcast))
    shelf.drop(often)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    whole = shelf.put(whole.groupBy("key", "node").agg(F.sum("shared").alias("shared")), "jaccard-met")
    shelf.drop(*found)
    trees = shelf.put(_least_trees(whole, sketch), "jaccard-trees")
    shelf.drop(whole)
    return trees


def _least_trees(members: DataFrame, sketch: DataFrame) -> DataFrame:
    """The members (key, node, shared) without those of large trees that no link needs.

    Two linked sets share more shingles of their prefixes than ``spare``.  Trees
    have one order for all nodes, so if each node leaves the largest that hold
    ``spare`` of its shingles or fewer, the pair still meets in the least tree
    of a shingle that it shares.
    """
    crowds = members.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"))
    spare = F.expr(f"({SPARE_PERCENT} * (({THRESHOLD_PERCENT} * n + 99) div 100)) div 100")
    largest = Window.partitionBy("node").orderBy(F.desc("crowd"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    sized = members.join(crowds, "key").join(sketch.select("node", spare.alias("spare")), "node")
    return sized.withColumn("left", F.sum("shared").over(largest)).where("left > spare").select("key", "node")


def _labelled(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def star_links(members: DataFrame, comps: DataFrame | None, sketch: DataFrame, docs: DataFrame, shelf: Shelf, turn: int) -> DataFrame:
    """Links between the points of each tree and its anchor, or later a drawn leader."""
    if comps is None:
        pairs = members.where("node <> key").select(F.col("node").alias("a"), F.col("key").alias("b"))
    else:
        alone = members.join(comps, "node", "left_anti").select("key", "node")
        draw = F.struct(F.xxhash64("node", F.lit(int(_MASKS[turn].view(np.int64)))), "node")
        leaders = alone.groupBy("key").agg(F.min(draw).alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1")
        pairs = alone.join(leaders.select("key", F.col("lead.node").alias("b")), "key").where("node <> b")
        pairs = pairs.select(F.col("node").alias("a"), "b").distinct()
    # sizes rule out most pairs before any vector moves
    sizes = sketch.select("node", "n")
    sized = pairs.join(sizes.toDF("a", "n1"), "a").join(sizes.toDF("b", "n2"), "b")
    pairs = shelf.put(sized.where("4 * n1 >= 3 * n2 and 4 * n2 >= 3 * n1").select("a", "b"), "jaccard-sized")
    close = possible(pairs, sketch, points, _bit_spare, shelf)
    links = verified(close, sketch, docs, shelf)
    shelf.drop(pairs, close)
    return links


def _blocks(labelled: DataFrame) -> DataFrame:
    """home, block, node, comp, side, trees: where each node of a mixed tree is compared.

    A tree of up to BLOCK_NODES is one block (side 0); such trees are at home with
    the least anchor that their own anchor is under, and a node travels once for
    all its trees of a home.  Other trees are their own home.  In a larger one, nodes of
    a class (sizes within a third of each other, and whether of the tree's
    largest component) fall into blocks; pairs of blocks of the same or the next
    sizes meet (sides 1 and 2), but not two of the largest component.
    """
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    each = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    trees = each.groupBy("key").agg(F.sum("k").alias("nodes"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("major"))
    mixed = labelled.join(trees.where("comps > 1").select("key", "nodes", "major"), "key")
    kind = F.when(F.col("comp") == F.col("major"), F.lit(1)).otherwise(F.lit(0))
    mixed = mixed.select("key", "node", "comp", "nodes", (size * 2 + kind).alias("class"))
    homes = labelled.groupBy(F.col("node").alias("key")).agg(F.min("key").alias("home"))
    small = mixed.where(F.col("nodes") <= BLOCK_NODES).select("key", "node", "comp").join(homes, "key", "left")
    small = small.withColumn("home", F.coalesce("home", "key"))  # an anchor that is under no other
    crowd = small.groupBy("home").agg(F.count(F.lit(1)).alias("k"))
    home = F.when(F.col("k") <= HOME_NODES, F.col("home")).otherwise(F.col("key")).alias("home")
    small = small.join(crowd, "home").select(home, "key", "node", "comp")
    small = small.groupBy("home", "node", "comp").agg(F.collect_list("key").alias("trees"))
    small = small.select("home", F.lit(0).cast("long").alias("block"), "node", "comp", F.lit(0).alias("side"), "trees")
    large = mixed.where(F.col("nodes") > BLOCK_NODES)
    of_class = large.groupBy("key", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).cast("int").alias("blocks"))
    of_tree = of_class.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("class", "blocks"))).alias("by"))
    count_of = lambda c: F.coalesce(F.try_element_at("by", c), F.lit(0))
    placed = large.join(of_tree, "key").withColumn("i", F.pmod(F.xxhash64("node"), count_of(F.col("class"))).cast("int"))

    def meets(step: int, own: int, other: int) -> Column:
        """Blocks of the kind ``other``, ``step`` sizes up, that this node's block meets."""
        low, c = (1, F.col("class")) if (step, own) < (0, other) or step > 0 else (2, F.col("class"))
        theirs = c + 2 * step + (other - own)
        within = step == 0 and own == other

        def target(j: Column) -> Column:
            i = F.col("i")
            first, second = (F.least(i, j), F.greatest(i, j)) if within else (i, j) if low == 1 else (j, i)
            lower, upper = (c, theirs) if low == 1 or within else (theirs, c)
            # at most 2^20 blocks a class, 2^11 classes
            code = ((lower.cast("long") * 8 + (upper - lower + 3)) * (1 << 20) + first) * (1 << 20) + second
            side = F.when(i == j, 0).when(i < j, 1).otherwise(2) if within else F.lit(low)
            return F.struct(code.alias("block"), side.cast("int").alias("side"))

        wanted = (c % 2 == own) & (count_of(theirs) > 0)
        return F.when(wanted, F.transform(F.sequence(F.lit(0), count_of(theirs) - 1), target)).otherwise(F.array())

    kinds = [(step, own, other) for step in (-1, 0, 1) for own in (0, 1) for other in (0, 1) if not own == other == 1]
    spread = placed.select("key", "node", "comp", F.explode(F.concat(*(meets(*k) for k in kinds))).alias("to"))
    return small.unionByName(spread.select(F.col("key").alias("home"), "to.block", "node", "comp", "to.side", F.array("key").alias("trees")))


def tree_links(
    members: DataFrame, comps: DataFrame, sketch: DataFrame, docs: DataFrame, shelf: Shelf, best: bool
) -> tuple[DataFrame, DataFrame]:
    """Links between nodes of different components that share a tree, and the members of open trees.

    With ``best`` a tree of too many pairs gives only the likeliest of each node
    and stays open; otherwise all pairs are compared and none does.
    """
    sized = _labelled(members, comps).join(sketch.select("node", "n"), "node")
    placed = shelf.put(_blocks(sized), "jaccard-blocks")
    trees = placed.join(points(_among(sketch, placed)), "node").select("home", "block", "node", "comp", "n", "bits", "side", "trees")
    # two trees may both hold a pair: it is verified once
    join = _join_best if best else _join_all
    found = trees.repartition("home", "block").sortWithinPartitions("home", "block").mapInArrow(tidy(join), "a long, b long")
    found = shelf.put(found.distinct(), "jaccard-pairs")
    links = verified(found.where("b is not null"), sketch, docs, shelf)
    opened = found.where("b is null").select(F.col("a").alias("key"))
    left = shelf.put(members.join(opened, "key", "left_semi"), "jaccard-open")
    shelf.drop(placed, found)
    return links, left


def link_documents(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, node, comp: one row per document.

    ``node`` numbers the rows; ``comp`` is the component's least node.
    """
    docs, shelf = id_text(documents), Shelf(documents.sparkSession)
    sketch, prefixes = sketch_documents(docs, shelf)
    filled = sketch.where("n > 0")
    copies = filled.groupBy("digest", "n").agg(F.min("node").alias("rep"))
    members = shelf.put(filled.join(copies, ["digest", "n"]).select("node", "rep"), "jaccard-members")
    repeats = members.where("node <> rep").select("node")
    trees = tree_members(sketch, prefixes, repeats, shelf)
    comps, links = None, []

    def contract(new: DataFrame) -> DataFrame:
        links.append(new)
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        if comps is not None:
            shelf.drop(comps)
        return components(found, shelf)

    for turn in range(STAR_ROUNDS):
        comps = contract(star_links(trees, comps, sketch, docs, shelf, turn))
    # the stars decided every pair with an anchor
    best, left = True, trees.where("node <> key")
    while left.limit(1).count():
        new, after = tree_links(left, comps, sketch, docs, shelf, best)
        comps = contract(new)
        best = best and new.count() >= ROUND_LINKS
        shelf.drop(left)
        left = after
    groups = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "node", F.coalesce("comp", "rep").alias("comp")
    )
    rows = sketch.select("node", "doc_id", "text_hash", F.col("n").alias("n_shingles")).join(groups, "node", "left")
    rows = shelf.put(rows.withColumn("comp", F.coalesce("comp", "node")), "jaccard-rows")
    shelf.drop(sketch, members, trees, left, comps, *links)
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "comp").select("doc_id", "text_hash", "n_shingles", "component_id", "node", "comp")


def drop_copies(documents: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the least id.

    Rows without words stay, as they link with nothing.  Of rows that repeat in
    id and text, one stays where the text has words.  Other columns may have any
    name.
    """
    rows = link_documents(documents)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"), F.col("node"))
    winners = rows.groupBy("comp").agg(F.min_by(F.struct("doc_id", "text_hash", "n_shingles"), order).alias("w"))
    winners = winners.select("w.*").distinct().select(F.struct("doc_id", "text_hash").alias("place"), (F.col("n_shingles") > 0).alias("words"))
    # the row travels as one struct, so that no name of its columns can clash
    packed = documents.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in documents.columns)).alias("row"))
    place = F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("text_hash"))
    shelf = Shelf(documents.sparkSession)
    winners = shelf.put(winners, "jaccard-winners")
    kept = packed.withColumn("place", place).join(winners, "place")
    repeated = rows.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if repeated:
        words = kept.where("words").dropDuplicates(["place"])
        kept = words.unionByName(kept.where("NOT words"))
    return kept.select("row.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(w[i : i + 4]) AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) >= 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= {THRESHOLD_PERCENT} * (p.n + q.n - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (
  SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(l.y, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least l ON l.x = w.doc_id
"""
