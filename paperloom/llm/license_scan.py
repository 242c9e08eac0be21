"""Operator 2: licence scans with MinHash bands, in DataFrame operations.

Texts and templates are lower-cased words in shingles of five.  A template of
``BLOCK`` shingles or more is cut into pieces of ``BLOCK`` shingles; texts are
cut into windows of two blocks, one block apart, so that a run of ``BLOCK``
shingles at any place lies whole in some window.  Each window has ``BANDS``
MinHash values of one row each, and a window that shares a band with a piece
retrieves the piece's template.  A piece whose shingles are there to three
quarters has a Jaccard similarity of 1/3 or more with its window, so a piece
is found with probability 1 - (2/3)^16 > 0.998, and a template of several
pieces with more.  Shorter templates get windows of one shingle, whose MinHash
is the shingle itself, so that none is missed.

Retrieved (document, template) pairs are then verified exactly: the share of
the template's distinct shingles that occur in the whole text must be 0.75 or
more.  Only the pairs and the texts they name move; windows never shuffle.

Edge cases: null, empty and shorter texts match nothing; templates of fewer
than five words are refused (``scan_notices`` finds those, word by word); repeated rows each
match; null ids stay null; other columns are not read; empty tables give no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, id_text, read_table, stored
from .license_templates import NOTICES, TEMPLATES

WIDTH = 5
BLOCK = 8
BANDS = 16
CONTAINMENT_PERCENT = 75
#: Band values and shingles of all templates that are still broadcast.
BROADCAST_BOUND = 200_000


def _mask(band: int) -> Column:
    """A fixed 64-bit mask per band; the leading four bits tell bands apart."""
    value = (band << 60) | ((0x9E3779B97F4A7C15 * (band + 1)) & ((1 << 60) - 1))
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def _shingles(text: Column) -> Column:
    """64-bit hashes of the text's shingles in order; none under five words."""
    words = F.array_remove(F.split(F.lower(text), f"{SPACE_CLASS}+"), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def rows(h: Column) -> Column:
        n = F.size(h)
        at = F.when(n >= WIDTH, F.sequence(F.lit(0), n - WIDTH)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]))

    return F.element_at(F.transform(F.array(hashed), rows), 1)


def _minima(shingles: Column, size: int) -> list[Column]:
    """Band values of up to ``size`` shingles of an array column."""
    return _band_values([F.get(shingles, F.lit(k)) for k in range(size)])


def _band_values(cells: list[Column]) -> list[Column]:
    return [F.least(*[c.bitwiseXOR(_mask(b)) for c in cells]) for b in range(BANDS)]


def _templates(spark: SparkSession, templates) -> DataFrame:
    rows = [(str(k), str(t)) for k, t in templates]
    for name, text in rows:
        if len(text.split()) < WIDTH:
            raise ValueError(f"template {name} has fewer than {WIDTH} words")
    return spark.createDataFrame(rows, "template string, text string").select(
        "template", F.array_distinct(_shingles(F.col("text"))).alias("own"), _shingles(F.col("text")).alias("run")
    )


def _small(df: DataFrame) -> DataFrame:
    """Broadcast only when counted to be within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_BOUND else df


def retrieve(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Distinct (doc_id, text_hash, template) that share a band or a shingle."""
    long = F.size("run") >= BLOCK
    n = F.size("run")
    # the last piece ends with the template, so pieces cover all of it
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), n - BLOCK, F.lit(BLOCK)), F.array(n - BLOCK)))
    pieces = templates.where(long).select("template", F.explode(starts).alias("at"), "run")
    pieces = pieces.select("template", F.slice("run", F.col("at") + 1, BLOCK).alias("piece"))
    bands = pieces.select("template", F.explode(F.array(*_minima(F.col("piece"), BLOCK))).alias("band")).distinct()
    singles = templates.where(~long).select("template", F.explode("own").alias("band")).distinct()

    # one pass: each window gives its band values and its first block's shingles
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _shingles(F.col("text")).alias("run"))
    none = F.array().cast("array<array<bigint>>")
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(BLOCK))
    cut = F.when(n > 0, F.transform(at, lambda i: F.slice("run", i, 2 * BLOCK))).otherwise(none)
    windows = hashed.select("doc_id", "text_hash", F.explode(cut).alias("w"))
    # cells become columns first, so that each is taken from its array once
    names = [f"c{k}" for k in range(2 * BLOCK)]
    cells = windows.select("doc_id", "text_hash", *[F.get("w", F.lit(k)).alias(c) for k, c in enumerate(names)])
    values = _band_values([F.col(c) for c in names])
    banded = cells.select("doc_id", "text_hash", *names[:BLOCK], *[v.alias(f"b{k}") for k, v in enumerate(values)])
    keys = F.array(*[f"b{k}" for k in range(BANDS)], *names[:BLOCK])
    probes = banded.select("doc_id", "text_hash", F.explode(keys).alias("band"))
    found = probes.join(_small(bands.unionByName(singles)), "band")
    return found.groupBy("doc_id", "text_hash", "template").agg(F.count(F.lit(1)).alias("hits")).drop("hits")


def verify(docs: DataFrame, candidates: DataFrame, templates: DataFrame) -> DataFrame:
    """Exact containment of each retrieved template in its whole text."""
    wanted = candidates.groupBy("doc_id", "text_hash").agg(F.collect_set("template").alias("templates"))
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(wanted["doc_id"]) & (keyed["text_hash"] == wanted["text_hash"])
    texts = keyed.join(wanted, same).select(keyed["doc_id"], "text", "templates")
    pairs = texts.select("doc_id", F.array_distinct(_shingles(F.col("text"))).alias("theirs"), F.explode("templates").alias("template"))
    own = templates.select("template", "own")
    return (
        pairs.join(_small(own), "template")
        .select(
            "doc_id",
            "template",
            F.size(F.array_intersect("own", "theirs")).cast("long").alias("n_matched"),
            F.size("own").cast("long").alias("n_shingles"),
        )
        .where(100 * F.col("n_matched") >= CONTAINMENT_PERCENT * F.col("n_shingles"))
    )


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, template, n_matched, n_shingles of every licence found."""
    texts = id_text(docs).where("text is not null")
    known = _templates(docs.sparkSession, templates)
    candidates = stored(retrieve(texts, known), "license-candidates")
    return verify(texts, candidates, known)


def scan_notices(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """Like ``scan_licenses`` for texts of one to four words, as whole words in a row.

    A notice is one shingle of its own width; every window of a text is compared.
    """

    def spaced(text: Column) -> Column:
        words = F.array_remove(F.split(F.lower(text), f"{SPACE_CLASS}+"), "")
        return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    for name, text in notices:
        if not 1 <= len(text.split()) < WIDTH:
            raise ValueError(f"notice {name} has not one to {WIDTH - 1} words")
    texts = id_text(docs).where("text is not null").select("doc_id", spaced(F.col("text")).alias("spaced"))
    found = [F.when(F.contains("spaced", spaced(F.lit(text))), F.lit(name)) for name, text in notices]
    one = F.lit(1).cast("long")
    hits = texts.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("template"))
    return hits.select("doc_id", "template", one.alias("n_matched"), one.alias("n_shingles"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan_licenses(docs).unionByName(scan_notices(docs))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = rf"""
WITH t(template, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES)}),
texts AS (
  SELECT NULL::BIGINT AS doc_id, template, text FROM t
  UNION ALL SELECT doc_id, NULL, text FROM documents WHERE text IS NOT NULL),
words AS (
  SELECT doc_id, template, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
shingles AS (
  SELECT DISTINCT doc_id, template, w[i : i + 4] AS s
  FROM (SELECT doc_id, template, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
sizes AS (SELECT template, count(*) AS n FROM shingles WHERE template IS NOT NULL GROUP BY template),
hits AS (
  SELECT d.doc_id, q.template, count(*) AS n_matched
  FROM shingles q JOIN shingles d ON q.s = d.s AND q.template IS NOT NULL AND d.template IS NULL
  GROUP BY d.doc_id, q.template)
SELECT doc_id, template, CAST(n_matched AS BIGINT) AS n_matched, CAST(n AS BIGINT) AS n_shingles
FROM hits JOIN sizes USING (template) WHERE 100 * n_matched >= {CONTAINMENT_PERCENT} * n
UNION ALL
SELECT d.doc_id, q.name, CAST(1 AS BIGINT), CAST(1 AS BIGINT)
FROM words d, (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in NOTICES)}) q(name, notice)
WHERE d.template IS NULL AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || lower(q.notice) || ' ')
"""
