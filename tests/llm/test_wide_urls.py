"""Mined rules of urls with many common tokens."""

from paperloom.llm import url_filters
from paperloom.llm.common import Shelf


def test_every_common_token_of_a_wide_url_teaches(spark):
    """The pair that decides is blocked less often, token by token, than 13 others of the same urls."""
    wide, a, b = [f"p:{c:02d}" for c in range(13)], "h:a", "h:b"
    kinds = [(100, [*wide, a, b], True), (40, [*wide, a], False), (40, [*wide, b], False), (290, wide, True), (30, wide, False), (200, [a], False), (200, [b], False)]
    table = spark.createDataFrame([(tokens, blocked) for n, tokens, blocked in kinds for _ in range(n)], "tokens array<string>, blocked boolean")
    rules = url_filters.mine(table, Shelf(spark), min_held=90)
    assert {tuple(sorted(r["tokens"])) for r in rules.collect()} == {(a, b)}


def test_tokens_of_the_same_urls_are_choices_of_one_rule(spark):
    names = [f"q:{c:02d}" for c in range(40)]
    rows = [([*(names if k % 2 else []), *(["h:x"] if k % 3 else [])], k % 2 == 1 and k % 3 > 0) for k in range(240)]
    table = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    rules = url_filters.mine(table, Shelf(spark), min_held=30)
    assert [sorted(r["tokens"]) for r in rules.collect()] == [["h:x", "q:00"]]
    urls = spark.createDataFrame([("both", ["h:x", "q:17"]), ("one", ["q:17", "q:18"]), ("other", ["h:x", "q:99"])], "url string, tokens array<string>")
    assert {r["url"] for r in url_filters.matches(urls, rules).collect()} == {"both"}
