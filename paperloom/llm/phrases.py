"""Operator 13: phrase collocations, counted by sorting packed word ids.

``encode_blocks`` folds whole texts into blocks of words of one language, each
with the distinct words it holds and its own codes for them, so that text is
read once and only distinct words of blocks are shuffled.  Words that occur
often enough get ids by a join; all others, and the ends of pieces, become 0,
where every phrase breaks.  ``phrase_counts`` packs the four ids from each
place on into one key of fixed width, sorts and counts the keys within a task,
deals the runs out by key range, sorts them there once more by radix and counts
the runs of every prefix: one sorted order gives all phrases of two to four
words.  A run that a range's border may have cut is summed afterwards.

Edge cases: a null text is empty, a null language is ``und``, ids are not read,
repeated rows count each time, other columns are not read, an empty table gives
no rows.  Very long texts are folded in slices; a phrase across two slices or
blocks is counted once, as a block that ends inside a text lends its last words
to the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, read_table, tidy, writing

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
#: A phrase goes if a longer one has so many percent of its occurrences.
CONTAINED_PERCENT = 80
SCALE = 2_000_000

#: Words of a block; keys that a task sorts at once; keys of a range.
BLOCK_WORDS = 1 << 20
CHUNK_KEYS = 1 << 21
RANGE_KEYS = 1 << 20
#: Blocks and keys a range from which the borders of ranges are read: they bear on balance alone.
SAMPLE_BLOCKS = 2048
SAMPLE_KEYS = 32
_SLICE = 1 << 20

_BREAK = b"\xff"  # no byte of UTF-8
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
_FOLD[9] = 32
for _mark in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_mark] = 255
_FOLD = bytes(_FOLD)
_GAP = re.compile(rb"[\x20\xff]")


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, with ``_BREAK`` between pieces; cut between words."""
    folded, low = text.translate(_FOLD), 0
    while low < len(folded):
        gap = _GAP.search(folded, low + _SLICE) if low + _SLICE < len(folded) else None
        high = gap.start() if gap else len(folded)
        yield folded[low:high].replace(_BREAK, b" \xff ").split()
        low = high


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class _Block:
    """Codes of the words of one language, until it is handed on."""

    def __init__(self, lang: str, lent: list[bytes] = ()):
        self.lang, self.codes, self.parts, self.size = lang, _Codes({_BREAK: 0}), [], 0
        self.add(lent)

    def add(self, words: list[bytes]) -> None:
        if words:
            self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
            self.size += len(words)

    def handed(self, lent: int) -> pa.RecordBatch:
        codes = np.concatenate(self.parts)
        n = np.bincount(codes[: len(codes) - lent], minlength=len(self.codes))[1:]
        words = pa.array(list(self.codes)[1:], pa.binary()).cast(pa.string())
        ends = pa.array([0, len(words)], pa.int32())
        columns = [pa.array([self.lang]), pa.array([int(n.sum())]), pa.ListArray.from_arrays(ends, words)]
        columns += [pa.ListArray.from_arrays(ends, pa.array(n, pa.int64())), pa.array([len(codes) - lent], pa.int32()), pa.array([codes.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "n_words", "words", "n", "own", "codes"])


_BLOCKS = "lang string, n_words long, words array<string>, n array<long>, own int, codes binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Block] = {}
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            block = held.setdefault(lang, _Block(lang))
            for words in _slices(text.as_py() or b""):
                if block.size >= BLOCK_WORDS:  # the text goes on: its last words begin the next block
                    lent = lent_words(block)
                    yield block.handed(len(lent))
                    block = held[lang] = _Block(lang, lent)
                block.add(words)
            block.add([_BREAK])
            if block.size >= BLOCK_WORDS:
                yield held.pop(lang).handed(0)
            elif sum(b.size for b in held.values()) >= 4 * BLOCK_WORDS:
                yield held.pop(max(held, key=lambda x: held[x].size)).handed(0)
    for block in held.values():
        yield block.handed(0)


def lent_words(block: _Block) -> list[bytes]:
    last = np.concatenate(block.parts[-LONGEST:])[-(LONGEST - 1) :].tolist()
    names = list(block.codes)
    return [names[code] for code in last]


def encode_blocks(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = texts.mapInArrow(tidy(_encode), _BLOCKS)
    return blocks.select(F.monotonically_increasing_id().alias("block"), "*")


def dictionary(blocks: DataFrame, shelf: Shelf, min_count: int) -> DataFrame:
    """``lang, word, n, id``: frequent words, numbered without gaps from 1.

    Words are numbered within the partitions they were written by; only one row
    a partition is gathered for the partitions' beginnings.
    """
    counted = blocks.select("lang", F.inline(F.arrays_zip("words", "n"))).groupBy("lang", F.col("words").alias("word"))
    frequent = counted.agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    place = F.monotonically_increasing_id()
    placed = shelf.put(frequent.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at")), "phrase-words")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("part", F.coalesce(before, F.lit(0)).alias("begin"))
    return placed.join(F.broadcast(begins), "part").select("lang", "word", "n", (F.col("begin") + F.col("at") + 1).alias("id"))


def encode_ids(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """``block, own, codes, ids``: of each block the ids of its codes, as ``code << 32 | id``."""
    used = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    found = used.join(words.select("lang", "word", "id"), ["lang", "word"])
    pair = F.shiftleft((F.col("at") + 1).cast("long"), 32).bitwiseOR(F.col("id"))
    ids = found.groupBy("block").agg(F.collect_list(pair).alias("ids"))
    return blocks.select("block", "own", "codes").join(ids, "block")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Of each block the ids from each place on, four a row; places without a phrase are left out."""
    for batch in batches:
        for own, codes, ids in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            codes = np.frombuffer(codes.as_buffer(), np.int32)
            pairs = ids.values.to_numpy()
            known = np.zeros(int(max(codes.max(), (pairs >> 32).max())) + 1, np.uint32)
            known[pairs >> 32] = pairs & 0xFFFFFFFF
            row = np.zeros(len(codes) + LONGEST - 1, np.uint32)
            row[: len(codes)] = known[codes]
            keys = np.lib.stride_tricks.sliding_window_view(row, LONGEST)[:own]
            keys = keys[(keys[:, 0] != 0) & (keys[:, 1] != 0)]
            for k in range(2, LONGEST):  # nothing follows a break
                keys[:, k][keys[:, k - 1] == 0] = 0
            del codes, pairs, known, row
            yield keys
            del keys


def _sorted_runs(held: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their sums: radix passes over 16 bits, last word first.

    ``held``: keys with their counts (none: one each); it is emptied, and one id
    of the keys is moved after the other, so that they are not held whole a third time.
    """
    words = [np.concatenate([keys[:, k] for keys, _ in held]) for k in range(LONGEST)]
    n = None if held[0][1] is None else np.concatenate([n for _, n in held])
    held.clear()
    order = None
    for word in reversed(words):
        for shift in (0, 16):
            digit = (word if order is None else word[order]) >> np.uint32(shift)
            digit = digit.astype(np.uint16)
            if digit.any():
                at = np.argsort(digit, kind="stable").astype(np.uint32)
                order = at if order is None else order[at]
    new = np.zeros(len(words[0]), bool)
    new[:1] = True
    for k, word in enumerate(words):
        words[k] = word = word if order is None else word[order]
        new[1:] |= word[1:] != word[:-1]
    begin = np.flatnonzero(new)
    if n is None:
        n = np.diff(begin, append=len(new))
    elif len(begin):
        n = np.add.reduceat(n if order is None else n[order], begin)
    del order, new
    keys = np.empty((len(begin), LONGEST), np.uint32)
    for k in range(LONGEST):
        keys[:, k] = words[k][begin]
        words[k] = None
    return keys, n


def _begins(keys: np.ndarray, width: int) -> np.ndarray:
    """Where a run of equal first ``width`` ids begins."""
    new = np.ones(len(keys), bool)
    if len(keys):
        new[1:] = (keys[1:, :width] != keys[:-1, :width]).any(axis=1)
    return new


def _place(keys: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """For each border the number of sorted keys before it."""

    def half(rows: np.ndarray, first: int) -> np.ndarray:
        wide = rows[:, first].astype(np.uint64)
        wide <<= np.uint64(32)
        wide |= rows[:, first + 1]
        return wide

    high, border_high, border_low = half(keys, 0), half(borders, 0), half(borders, 2)
    at, end = np.searchsorted(high, border_high), np.searchsorted(high, border_high, "right")
    for k in np.flatnonzero(end > at):
        at[k] += np.searchsorted(half(keys[at[k] : end[k]], 2), border_low[k])
    return at


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Keys word by word and then the counts, compressed: sorted columns shrink well."""
    plain = np.concatenate([keys.T.ravel().astype("<u4").view(np.uint8), n.astype("<i8").view(np.uint8)])
    return pa.compress(pa.py_buffer(plain), "zstd", asbytes=True)


def _unpacked(size: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    plain = np.frombuffer(pa.decompress(packed, size * (4 * LONGEST + 8), "zstd"), np.uint8)
    keys = plain[: size * 4 * LONGEST].view("<u4").reshape(LONGEST, size).T
    return np.ascontiguousarray(keys), plain[size * 4 * LONGEST :].view("<i8")


def _sample(a_block: int):
    """Evenly spaced keys of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _windows(batches):
            picked = keys[:: max(1, len(keys) // a_block)]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(picked).tobytes()], pa.binary())], names=["keys"])

    return run


def _borders(encoded: DataFrame, n_blocks: int, n_ranges: int) -> np.ndarray:
    """Range borders from a bounded sample of keys, distinct ones counting once."""
    near = encoded.where(F.pmod(F.xxhash64("block"), F.lit(max(1, n_blocks // SAMPLE_BLOCKS))) == 0)
    a_block = -(-SAMPLE_KEYS * n_ranges // min(n_blocks, SAMPLE_BLOCKS)) if n_blocks else 1
    with writing(encoded.sparkSession):  # a row may hold a whole block
        rows = near.mapInArrow(tidy(_sample(a_block)), "keys binary").collect()
    found = [np.frombuffer(r["keys"], np.uint32).reshape(-1, LONGEST) for r in rows]
    keys = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, LONGEST), np.uint32)
    return keys[[len(keys) * k // n_ranges for k in range(1, n_ranges)]] if len(keys) else keys


def _deal(borders: np.ndarray):
    """Sorted runs of the keys of a task, cut at the borders of the ranges."""

    def dealt(held: list[tuple[np.ndarray, None]]) -> Iterator[pa.RecordBatch]:
        keys, n = _sorted_runs(held)
        cuts = [0, *_place(keys, borders).tolist(), len(keys)]
        for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if high > low:
                columns = [pa.array([k], pa.int32()), pa.array([high - low], pa.int64()), pa.array([_packed(keys[low:high], n[low:high])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "size", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for keys in _windows(batches):
            held.append((keys, None))
            size += len(keys)
            del keys  # what is dealt is held here alone
            if size >= CHUNK_KEYS:
                yield from dealt(held)
                size = 0
        if size:
            yield from dealt(held)

    return run


def _count_runs(min_count: int):
    """Counts of the phrases of each range; those that a border may have cut come whatever their count."""

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, n = _sorted_runs(parts)
        for width in range(2, LONGEST + 1):
            begin = np.flatnonzero(_begins(keys, width))
            a = np.add.reduceat(n, begin)
            wanted = a >= min_count
            wanted[[0, -1]] = True
            wanted &= keys[begin, width - 1] != 0
            found = keys[begin[wanted], :width].astype(">u4")
            packed = pa.Array.from_buffers(pa.binary(4 * width), len(found), [None, pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_arrays([packed.cast(pa.binary()), pa.array(a[wanted])], names=["key", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for at, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(at, []).append(_unpacked(size, packed))
        while held:
            yield from counted(held.popitem()[1])

    return run


def phrase_counts(encoded: DataFrame, n_blocks: int, n_words: int, min_count: int = MIN_COUNT) -> DataFrame:
    """``key, a``: phrases of two to ``LONGEST`` words as four bytes an id, and all their occurrences."""
    n_ranges = max(int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_words // RANGE_KEYS))
    borders = _borders(encoded, n_blocks, n_ranges)
    dealt = encoded.mapInArrow(tidy(_deal(borders)), "range int, size long, packed binary")
    runs = dealt.repartitionById(n_ranges, F.col("range")).mapInArrow(tidy(_count_runs(min_count)), "key binary, a long")
    return runs.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def _ids(key: Column, begin: int | Column, n: int | Column) -> Column:
    """``n`` ids of a key from the ``begin``-th on."""
    return F.substring(key, F.lit(4) * begin + 1, F.lit(4) * n)


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of each language of ``docs(lang, text)``."""
    shelf = Shelf(docs.sparkSession)
    blocks = shelf.put(encode_blocks(docs), "phrase-blocks")
    totals = shelf.put(blocks.groupBy("lang").agg(F.sum("n_words").alias("n"), F.count("*").alias("blocks")), "phrase-totals")
    n_blocks, n_words = (x or 0 for x in totals.agg(F.sum("blocks"), F.sum("n")).first())
    words = shelf.put(dictionary(blocks, shelf, min_count), "phrase-dictionary")
    if n_words // min_count >> 32 and words.where(F.col("id") >= 1 << 32).limit(1).count():
        raise ValueError("more frequent words than four bytes can number")
    encoded = shelf.put(encode_ids(blocks, words), "phrase-ids")
    shelf.drop(blocks)
    phrases = shelf.put(phrase_counts(encoded, n_blocks, n_words, min_count), "phrase-counts")
    shelf.drop(encoded)

    size = F.shiftright(F.octet_length("key"), 2)
    word_key = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    counts = phrases.select("key", "a").unionByName(words.select(word_key.alias("key"), F.col("n").alias("a")))

    # each phrase against the longer ones that hold it
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(0), size - n), lambda at: _ids(F.col("key"), at, n))))
    held = phrases.where(size >= 3).select(F.explode(inner).alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    stays = F.expr(f"longer IS NULL OR 100 * cast(longer AS decimal(20,0)) < {CONTAINED_PERCENT} * cast(a AS decimal(20,0))")
    kept = shelf.put(phrases.join(held, "key", "left").where(stays).select("key", "a"), "phrase-kept")

    cuts = kept.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    sides = cuts.select("key", "a", "cut", _ids(F.col("key"), F.lit(0), F.col("cut")).alias("left"), _ids(F.col("key"), F.col("cut"), size - F.col("cut")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        sides = sides.join(counts.select(F.col("key").alias(side), F.col("a").alias(name)), side)
    score = F.expr(f"{SCALE} * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + r)")
    scored = sides.withColumn("score", score).groupBy("key", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))

    named = kept.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda at: _ids(F.col("key"), at, F.lit(1)))).alias("at", "word_key"))
    named = named.join(words.select(word_key.alias("word_key"), "lang", "word"), "word_key").groupBy("key")
    texts = named.agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ready = scored.join(texts, "key").select("lang", "phrase", "a", F.col("least.l").alias("l"), F.col("least.r").alias("r"), F.col("least.score").alias("score"))

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best))
    first = ready.withColumn("place", some).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH low AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM low)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
spots AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (
  SELECT lang, p, len(p) AS k, count(*) AS a FROM (SELECT lang, list_slice(w, i, i + k - 1) AS p FROM spots)
  GROUP BY lang, p HAVING count(*) >= {MIN_COUNT}),
cand AS (SELECT * FROM f WHERE k >= 2),
held AS (
  SELECT lang, p, max(a) AS longer FROM (
    SELECT lang, a, list_slice(p, i, i + m - 1) AS p FROM (
      SELECT lang, a, p, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)))
  GROUP BY lang, p),
cuts AS (
  SELECT c.lang, c.p, c.a, cut, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, cut)
  JOIN f r ON r.lang = c.lang AND r.p = list_slice(c.p, cut + 1, c.k)),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
kept AS (
  SELECT s.*, array_to_string(s.p, ' ') AS phrase FROM least s LEFT JOIN held h ON h.lang = s.lang AND h.p = s.p
  WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < {CONTAINED_PERCENT} * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
