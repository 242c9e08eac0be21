"""Operator 12: which pages to keep, judged by their urls.

Stated rules come first: a rule names a host and the beginning of a path, fits
that host and all its subdomains, and the longest that fits wins.  What no rule
fits is judged by association rules: ``mine`` runs Spark's FP-growth over the
tokens of labelled urls and the label, and keeps combinations of tokens that
enough labelled urls hold and that are blocked often enough; a combination that
holds a kept smaller one is left out, as it could match nothing more.  Rules
are found by an inverted index: each is posted under its rarest token only, met
by the tokens of distinct urls, and verified as a whole.

Edge cases: a null url, and one without ``://``, has an empty host and path,
no tokens and the verdict ``allow``; so has an empty set of labels or of mined
rules; repeated rows are judged alike; null ids stay; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, read_table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The stated rules of the query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

#: Of the labelled urls, how many must hold a combination, and how many of those be blocked.
MIN_SUPPORT = 0.0005
MIN_HELD = 20
MIN_CONFIDENCE = 0.8

_BLOCKED = "="


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path and keys of the query, digits as ``0``."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)

    def some(kind: str, text: Column, cut: str) -> Column:
        return F.transform(F.filter(F.split(text, cut), lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))

    keys = F.regexp_replace(query, "=[^&]*", "")
    return F.array_distinct(F.concat(some("h:", host, r"\."), some("p:", path, "/"), F.when(host != "", some("q:", keys, "&")).otherwise(F.array().cast("array<string>"))))


def stated(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path`` of ``pages(page_id, url)``."""
    host, path = url_parts(F.col("url"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with ``rule_id``: each row for every rule of which its ``tokens`` hold one of each choice, perhaps repeatedly."""
    under = F.filter("choices", lambda some: F.array_contains(some, F.col("post")))[0]
    posts = rules.select("rule_id", "choices", F.explode(under).alias("post"))
    met = rows.withColumn("post", F.explode("tokens")).join(posts, "post")
    return met.where(F.forall("choices", lambda some: F.arrays_overlap(some, F.col("tokens")))).drop("post", "choices")


def mine(labelled: DataFrame, shelf: Shelf, min_support: float = MIN_SUPPORT, min_held: int = MIN_HELD, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``rule_id, tokens, post, choices``: combinations of tokens from ``labelled(tokens, blocked)`` that say "block".

    All common tokens of a url teach.  What could only repeat a smaller rule is left
    to no combination: a token that is a rule by itself, one that all urls hold, and
    all but one of the tokens that the same urls hold; ``choices`` are these, for
    each of the rule's ``tokens``.  What is gathered grows with the support alone:
    at most the tokens of a url, divided by it, are common enough to be in a rule.
    """
    spark = labelled.sparkSession
    rows = shelf.put(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"), "url-labelled")
    n = rows.count()
    held = max(min_held, min_support * n)
    none = spark.createDataFrame([], "rule_id long, tokens array<string>, post string, choices array<array<string>>")
    if n < held:
        return none
    each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    # which urls hold a token, as 128 bits
    holders = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("int")).alias("bad"), *holders)
    alike = counts.where(F.col("n") >= held).groupBy("n", "bad", "h1", "h2").agg(F.sort_array(F.collect_list("token")).alias("choice"))
    alone = (F.col("bad") / F.col("n") >= min_confidence).alias("alone")
    common = shelf.put(alike.select(F.col("choice")[0].alias("token"), "n", "choice", alone), "url-tokens")

    mixed = common.where(~F.col("alone") & (F.col("n") < n)).select("token")
    of_url = each.join(mixed, "token").groupBy("row", "blocked").agg(F.collect_list("token").alias("taught"))
    items = shelf.put(of_url.select(F.when(F.col("blocked"), F.array_append("taught", F.lit(_BLOCKED))).otherwise(F.col("taught")).alias("items")), "url-items")
    n_items = items.count()
    strong = common.where("alone").select(F.array("token").alias("tokens"))
    if n_items:
        # a rule is held so often and blocked in min_confidence of it; half an url keeps rounding up from losing one
        support = max(0.0, held * min_confidence - 0.5) / n_items
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=min_confidence).fit(items).associationRules
        said = found.where(F.col("consequent")[0] == _BLOCKED).withColumn("n", F.round(F.col("support") * n_items / F.col("confidence")))
        strong = strong.unionByName(said.where(F.col("n") >= held).select(F.sort_array("antecedent").alias("tokens")))
    rarest = F.min(F.struct("n", "token"))["token"].alias("post")
    posts = strong.select("tokens", F.explode("tokens").alias("token")).join(common, "token").groupBy("tokens").agg(rarest, F.collect_list("choice").alias("choices"))
    posted = shelf.put(posts.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "post", "choices"), "url-strong")
    wider = matches(posted.select(F.col("rule_id").alias("id"), "tokens"), posted).where(F.col("id") != F.col("rule_id")).select(F.col("id").alias("rule_id"))
    rules = shelf.put(posted.join(wider.distinct(), "rule_id", "left_anti"), "url-rules")
    shelf.drop(rows, items, common, posted)
    return rules


def labels_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``tokens, blocked`` of the pages that ``labels`` has under their id: blocked if toxic or of low quality."""
    bad = F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(bad.alias("blocked"))
    return pages.join(marked, "page_id").select(url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "blocked")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, **mining) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of ``pages(page_id, url)``."""
    shelf = Shelf(pages.sparkSession)
    split = parsed(pages)
    mined = mine(labels_of(split, labels), shelf, **mining)
    ruled = split.withColumn("fit", stated(F.col("host"), F.col("path"), rules))
    open_urls = ruled.where("fit IS NULL AND url IS NOT NULL").select("url", "host", "path").distinct()
    tokens = open_urls.select("url", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    blocked = matches(tokens, mined).select("url").distinct().withColumn("mined", F.lit("block"))
    told = ruled.join(blocked, "url", "left")
    verdict = F.coalesce("fit.verdict", "mined", F.lit("allow")).alias("verdict")
    return told.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


#: Every subset of a url's tokens is a possible combination.
ORACLE_SQL = rf"""
WITH cut AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '=[^&]*', '', 'g') AS keys
  FROM (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
told AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_sort(list_distinct(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || regexp_replace(x, '[0-9]+', '0', 'g')),
      list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g')),
      CASE WHEN host <> '' THEN list_transform(list_filter(string_split(keys, '&'), lambda x: x <> ''), lambda x: 'q:' || regexp_replace(x, '[0-9]+', '0', 'g')) ELSE [] END))) AS tokens
  FROM cut),
subsets AS (
  SELECT page_id, list_filter(tokens, lambda x, i: (m >> CAST(i - 1 AS INTEGER)) & 1 = 1) AS s
  FROM (SELECT page_id, tokens, unnest(range(1, 1 << len(tokens))) AS m FROM told)),
marked AS (SELECT doc_id, bool_or(coalesce(toxic = 1 OR quality = 0, false)) AS blocked FROM labels GROUP BY doc_id),
taught AS (SELECT count(*) AS n FROM told JOIN marked ON page_id = doc_id WHERE len(tokens) > 0),
rules AS (
  SELECT s FROM subsets JOIN marked ON page_id = doc_id, taught GROUP BY s, taught.n
  HAVING count(*) >= greatest({MIN_HELD}, {MIN_SUPPORT} * taught.n) AND count(*) FILTER (blocked) / count(*) >= {MIN_CONFIDENCE}),
mined AS (SELECT DISTINCT page_id FROM subsets SEMI JOIN rules USING (s))
SELECT told.page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN mined.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM told LEFT JOIN mined USING (page_id)
"""
