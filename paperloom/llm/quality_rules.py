"""Operator 3: line-first cleaning, in DataFrame operations.

Every line with a word is judged on its own: by punctuation (symbols, shouting,
a missing end mark), as navigation (separators between short items) and as
boilerplate (stock phrases).  Failing lines go; a document that loses more than
``MAX_LOSS_PERCENT`` of its words, or fails the base rules on its whole text,
is rejected.  One narrow projection over the documents: no shuffle.

Edge cases: a null text counts as empty; empty texts have 0 in all counts and
fail the base (fewer than 50 words); repeated rows are judged alike; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, id_text, read_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS_PERCENT = 50
#: A line of at least so many words must end in one of END_MARKS or, cut off,
#: have a sentence's end inside.
LINE_WORDS = 4
# Fixed values of the rules.
SYMBOLS = "[#*$%&|<>]"
SEPARATORS = " [|»›·•>] "
END_MARKS = (".", "!", "?", ":", ";", "…", '"', "'", ")", "”", "»", "。")
SENTENCE_MARKS = "[.!?…。]"
BOILERPLATE = (
    "all rights reserved",
    "cookie",
    "privacy policy",
    "terms of use",
    "terms of service",
    "click here",
    "sign up for",
    "subscribe to",
    "javascript",
    "lorem ipsum",
    "powered by",
    "share this",
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(at: Column) -> Column:
        """Words covered by windows that begin at the sorted places ``at``."""
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    def places(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(pairs: Column) -> Column:
            kept = F.filter(
                pairs,
                lambda x, k: (x["h"] == F.get(pairs, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(pairs, F.greatest(k - 1, F.lit(0)))["h"])),
            )
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        return let(ordered, repeated)

    def count(windows: Column) -> Column:
        distinct = F.size(F.array_distinct(windows))
        return F.when(distinct == F.size(windows), 0).otherwise(let(places(windows), covered))

    n = F.size(words)
    return F.when(n < 4, 0).otherwise(let(F.transform(F.sequence(F.lit(0), n - 3), window), count))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails one of the line rules."""

    def judge(x: Column) -> Column:
        n = F.size(words_of(x))
        low = F.lower(x)
        symbols = F.regexp_count(x, F.lit(SYMBOLS))
        shouts = F.regexp_count(x, F.lit("!"))
        separators = F.regexp_count(x, F.lit(SEPARATORS))
        ended = F.right(F.regexp_replace(x, SPACE_CLASS + r"+\z", ""), F.lit(1)).isin(*END_MARKS) | x.rlike(SENTENCE_MARKS)
        unended = (n >= LINE_WORDS) & ~ended
        stock = F.lit(False)
        for phrase in BOILERPLATE:
            stock = stock | low.contains(phrase)
        return (symbols * 2 > n) | ((n >= LINE_WORDS) & (shouts * 2 > n)) | (separators * 3 >= n) | unended | stock

    return judge(line)


def clean_lines(docs: DataFrame) -> DataFrame:
    """Adds to doc_id and text the base counts, the clean text and the verdict."""
    text = F.coalesce("text", F.lit(""))
    split = id_text(docs).select("doc_id", "text", words_of(text).alias("words"), F.split(text, "\n").alias("all_lines"))
    lines = split.withColumn("lines", F.filter("all_lines", lambda x: F.length(F.regexp_replace(x, SPACE_CLASS, "")) > 0))
    kept = lines.withColumn("kept_lines", F.filter("lines", lambda x: ~line_fails(x)))
    counted = kept.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("kept_lines").cast("long").alias("n_kept_lines"),
        F.size(words_of(F.array_join("kept_lines", "\n"))).cast("long").alias("n_kept_words"),
        F.array_join("kept_lines", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = 100 * (F.col("n_words") - F.col("n_kept_words")) > MAX_LOSS_PERCENT * F.col("n_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_kept_lines",
        "n_kept_words",
    )


_STOCK = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
_MARKS = ", ".join("'" + m.replace("'", "''") + "'" for m in END_MARKS)
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
lines AS (
  SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (
  SELECT doc_id, line, n,
    len(regexp_extract_all(line, '[#*$%&|<>]')) * 2 > n
    OR (n >= {LINE_WORDS} AND len(regexp_extract_all(line, '!')) * 2 > n)
    OR len(regexp_extract_all(line, ' [|»›·•>] ')) * 3 >= n
    OR (n >= {LINE_WORDS} AND right(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ({_MARKS}) AND NOT regexp_matches(line, '{SENTENCE_MARKS}'))
    OR {_STOCK} AS fails
  FROM lines WHERE n > 0),
line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (NOT fails) AS n_kept_lines, coalesce(sum(n) FILTER (NOT fails), 0) AS n_kept_words
  FROM judged GROUP BY doc_id),
win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, a, b, c FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT win.doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (doc_id, a, b, c)) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_kept_lines, 0) AS BIGINT) AS n_kept_lines,
    CAST(coalesce(n_kept_words, 0) AS BIGINT) AS n_kept_words
  FROM d LEFT JOIN line_counts USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND NOT (100 * (n_words - n_kept_words) > {MAX_LOSS_PERCENT} * n_words) AS kept,
  n_lines, n_kept_lines, n_kept_words
FROM counts
"""
