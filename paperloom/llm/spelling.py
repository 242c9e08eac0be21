"""Operator 11: spelling variants, words one edit apart and the form each stands for.

Words are runs of letters of whole texts with their numbers of occurrences.
``near_words`` is an even-partition pigeonhole join.  A word of length L is cut
into a first half of ``L div 2`` code points and the rest; of two words one edit
apart, one half is untouched.  The index holds both segments of every word; the
probes are the same substrings of words of equal length and those of words one
longer, shifted by one behind the edit.  A segment is shared by ever more words
as the corpus grows, so its group is never paired whole: the other half, which
holds the edit, is cut evenly once more by the same rule, and only words that
share a segment and one part of the other half are candidates.  The first
place where two words differ belongs to one of the four parts, so each pair is
kept from one key alone, without a shuffle for duplicates; survivors are
verified by edit distance.

Edge cases: a null text has no words; a null id is hashed as empty text;
repeated rows count each time; other columns are not read; an empty table gives
no rows; texts are whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, id_text, read_table, tidy

MIN_LENGTH = 7
MIN_COUNT = 2
#: A near word is a form if it occurs so many times as often.
FORM_TIMES = 10
#: Of the runs of a document, those whose checksum this divides lose a letter.
SLIP = 31
_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task counts before it hands them on.
_HELD = 1 << 18
#: Longer texts are searched without a list of all runs.
_LONG = 1 << 20


def _runs(text: bytes) -> Counter[str]:
    lowered = text.translate(_LOWER).decode()
    if len(lowered) < _LONG:
        return Counter(_RUN.findall(lowered))
    return Counter(m.group() for m in _RUN.finditer(lowered))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def handed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            begun = crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in _runs(text.as_py() or b"").items():
                h = crc32(word.encode(), begun)
                if h % SLIP == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < MIN_LENGTH:
                        continue
                held[word] += n
            if len(held) >= _HELD:
                yield handed()
    if held:
        yield handed()


def words_of(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words of ``MIN_LENGTH`` or more that occur ``MIN_COUNT`` times or more."""
    counted = id_text(docs).mapInArrow(tidy(_count_words), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _part(word: Column, begin: Column, end: Column | None = None) -> Column:
    """The code points from ``begin`` to before ``end``."""
    return F.substring(word, begin + 1, (F.length(word) if end is None else end) - begin)


def _keys(words: DataFrame, length: Column, shift: int) -> DataFrame:
    """Four rows a word: its keys as a word of ``length`` with ``shift`` letters inserted.

    Each key leaves out the part that holds the edit; ``upto`` is that part's
    end in the shorter word, null for the last part.
    """
    word = F.col("word")
    half = F.shiftright(length, 1)
    head, tail = F.shiftright(length, 2), half + F.shiftright(length - half, 1)
    first, second = _part(word, F.lit(0), half), _part(word, half + shift)
    left_out = [
        (first, _part(word, half, tail), F.lit(None).cast("int")),
        (first, _part(word, tail + shift), tail),
        (second, _part(word, F.lit(0), head), half),
        (second, _part(word, head + shift, half + shift), head),
    ]
    keys = [F.struct(F.xxhash64(length, F.lit(k), a, b).alias("key"), upto.alias("upto")) for k, (a, b, upto) in enumerate(left_out)]
    return words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.upto", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of distinct ``words(word, n)`` one edit apart, once."""
    length = F.length("word")
    index = _keys(words, length, 0)
    probes = index.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.lit(False).alias("longer")).unionByName(
        _keys(words, length - 1, 1).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.lit(True).alias("longer"))
    )
    index = index.select("key", "upto", F.col("word").alias("a"), F.col("n").alias("a_n"))
    # an equal longer prefix means that the first difference lies in a later part, whose key keeps the pair
    later = F.coalesce(F.col("b").startswith(F.substring(F.col("a"), F.lit(1), F.col("upto"))), F.lit(False))
    met = index.join(probes, "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & ~later)
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame, shelf: Shelf) -> DataFrame:
    """``word, root`` from ``forms(word, form)``: chains shorten by half each round, and end as counts grow tenfold a step."""
    roots = shelf.put(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while roots.where("moved").limit(1).count():
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = roots.select("word", "root").join(onward, "root", "left")
        step = found.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = shelf.put(step, "spelling-roots")
        shelf.drop(roots)
        roots = new
    return roots.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs(doc_id, text)``."""
    shelf = Shelf(docs.sparkSession)
    words = shelf.put(words_of(docs), "spelling-words")
    both = [F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")]
    ends = near_words(words).select(F.inline(F.array(*both)))
    most = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("most")
    near = ends.groupBy("word").agg(F.count("*").alias("n_near"), most)
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("most.near").alias("near"), (-F.col("most.less")).alias("near_n"))
    is_form = F.col("near_n") >= FORM_TIMES * F.col("n")
    judged = joined.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    judged = shelf.put(judged, "spelling-forms")
    shelf.drop(words)
    roots = _roots(judged.where("form IS NOT NULL").select("word", "form"), shelf)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(read_table(spark, sf_dir, "documents"))


#: The checksum byte by byte, and near words by what is left when one place of each is deleted.
ORACLE_SQL = rf"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
counted AS (SELECT d, w, count(*) AS n FROM runs WHERE length(w) >= {MIN_LENGTH} GROUP BY d, w),
codes AS (
  SELECT w, n, flatten(list_transform(string_split(d || ':' || w, ''), lambda c:
    CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS bytes FROM counted),
hashed AS (
  SELECT w, n, xor(list_reduce(bytes, lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)]), 4294967295::BIGINT), 4294967295) AS h
  FROM (SELECT w, n, list_transform(bytes, lambda x: CAST(x AS BIGINT)) AS bytes FROM codes), tab),
slipped AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
longer AS (SELECT DISTINCT a.word AS a, b.word AS b FROM words a JOIN cut b ON a.word = b.rest),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION ALL SELECT a, b FROM longer
  UNION ALL SELECT b, a FROM longer),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS form, max(w.n) AS form_n FROM pairs JOIN words w ON w.word = b GROUP BY a),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {FORM_TIMES} * n THEN form END AS form,
    CASE WHEN form_n >= {FORM_TIMES} * n THEN form_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
steps(word, last) AS (SELECT word, word FROM words UNION SELECT s.word, j.form FROM steps s JOIN judged j ON j.word = s.last WHERE j.form IS NOT NULL),
roots AS (SELECT s.word, s.last AS root FROM steps s JOIN judged j ON j.word = s.last WHERE j.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)
"""
