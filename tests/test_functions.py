"""Golden cases of the scalar functions, and voting."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import voting

GOLDEN = [
    (T.parse_quantity, [("3 5", 35), ("ИЗВ 12 7", 127), ("007", 7), ("a12b34", 12), ("a1b234", 234), ("-4", 4), ("0", None), ("", None), ("1 2", 12), (None, None)]),
    (T.parse_total, [("1 234 шт", 1234), ("0", 0), ("abc", None), ("", None), ("9" * 30, None)]),
    (T.parse_doc_number, [("№ 000163307", "163307"), ("000", "0"), ("x", None)]),
    (
        T.parse_doc_date,
        [
            ("2026-03-05 19:38:", "2026-03-05 19:38"),
            ("2026 03 05 1938", "2026-03-05 19:38"),
            ("2026-03-05T19:38", "2026-03-05 19:38"),
            ("20260305", None),
            ("9999-99-99 99:99", "9999-99-99 99:99"),
        ],
    ),
    (T.normalize_sku, [("NOVYGOD-CIF0001-\nАЛЫЙ", "NOVYGOD-CIF0001-АЛЫЙ"), ("AB\nCD", "AB-CD"), ("AB\n-CD", "AB-CD"), ("A B-\n\n C", "AB-C"), ("  ", None)]),
    (T.valid_sku, [("A-B-Я-150sm", True), ("A-B", False), ("A-B-C", False), ("A--Я", False), ("A-B-ЯC", False), (None, False), ("A-B-Я\n", False)]),
    (T.doc_number_from_id, [("15-0000163307", "163307"), ("15-0000000000", "0")]),
    (T.doc_id_from_number, [("163307", "15-0000163307"), ("12345678901", None), ("", None)]),
    (T.accept_item_barcode, [("1000076316479", "1000076316479"), ("1000076316479\n", None), ("12", None)]),
    (T.accept_doc_id, [("15-0000163307", "15-0000163307"), ("150000163307", None)]),
]


@pytest.mark.parametrize("function, cases", GOLDEN, ids=lambda x: getattr(x, "__name__", ""))
def test_golden(spark, function, cases):
    rows = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(cases)], "k int, raw string")
    got = {r.k: r.out for r in rows.select("k", function(F.col("raw")).alias("out")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


def test_merge_sku(spark):
    cases = [
        (None, "X", "X"),
        ("A-B-C", "X-Y-З", "A-B-З"),
        ("A-B", "X-Y-З", "A-B"),
        ("A-B-C-D", "X-Y-З", "A-B-C-D"),
        ("A-B-C-D", "X-Y-З-Q", "A-B-З-D"),
        ("A-B-C", "X-Y-", "A-B-C"),
        ("A-B-C", None, "A-B-C"),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r.k: r.out for r in rows.select("k", T.merge_sku(F.col("a"), F.col("b")).alias("out")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for *_, w in cases]


def test_parse_header(spark):
    cases = [
        ("15-0000163307\n163307 2026-03-05 19:38:", ("15-0000163307", "2026-03-05 19:38", "163307")),
        ("15-0000164 33 163307 2026-03-05 9:38", (None, "2026-03-05 09:38", "163307")),
        ("998200249347", ("99-8200249347", None, None)),
        ("5850", (None, None, "5850")),
        ("", (None, None, None)),
    ]
    rows = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(cases)], "k int, raw string")
    got = {r.k: (r.h.doc_id, r.h.doc_date, r.h.doc_number) for r in rows.select("k", T.parse_header(F.col("raw")).alias("h")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]


def test_votes_go_to_the_first_seen_of_equals(spark):
    rows = spark.createDataFrame([(0, ["a", None, "b", "b", "a"]), (1, [None, None]), (2, [])], "k int, v array<string>")
    got = {r.k: r.out for r in rows.select("k", voting.vote(F.col("v")).alias("out")).collect()}
    assert got == {0: "a", 1: None, 2: None}


def test_read_voted(spark):
    readings = [("x", 0, "b", 10.0), ("x", 1, "a", 50.0), ("x", 2, "a", 20.0), ("x", 3, "b", 30.0), ("x", 4, None, 99.0), ("y", 0, "", 5.0), ("z", 0, None, 1.0)]
    rows = spark.createDataFrame(readings, "key string, variant int, text string, confidence double")
    got = {r.key: (r.text, r.confidence, r.agreement) for r in voting.read_voted(rows).collect()}
    assert got == {"x": ("b", 30.0, 0.5), "y": (None, 5.0, 1.0)}


def test_staleness(spark):
    cases = [(None, 5, True), ("2026-03-05T10:00:00Z", 0, True), ("nonsense", 5, True), ("2026-03-04T12:00:00Z", 5, False), ("2026-03-04T11:59:59Z", 5, True), ("2027-01-01T00:00:00Z", 5, False)]
    rows = spark.createDataFrame([(k, s, n) for k, (s, n, _) in enumerate(cases)], "k int, s string, n int")
    got = {r.k: r.out for r in rows.select("k", T.is_stale(F.col("s"), F.col("n"), F.lit("2026-03-05T12:00:00Z"), 24).alias("out")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for *_, w in cases]
