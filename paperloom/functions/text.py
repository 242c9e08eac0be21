"""Parsing of noisy field readings as Spark expressions.

All take and return columns and stay inside the JVM.  Patterns are anchored
with ``\\A`` and ``\\z`` because ``$`` accepts a final newline, and white space
includes the no-break space, which ``\\s`` alone leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of ids, barcodes and dates.
DOC_ID = r"\A[0-9]{2}-[0-9]{10}\z"
ITEM_BARCODE = r"\A[0-9]{13}\z"
DOC_DATE = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})[ T]([0-9]{2}):([0-9]{2})\z"
DOC_ID_PREFIX = "15"
DOC_ID_DIGITS = 10

_WHITE = r"(?U)[\s ﻿]"
_EDGE = "[0-9A-Za-z_]"
_ID_IN_TEXT = rf"(?<!{_EDGE})([0-9]{{2}})[-\s]?([0-9]{{10}})(?!{_EDGE})"
_DATE_IN_TEXT = rf"(?<!{_EDGE})([0-9]{{4}})[-\s]([0-9]{{2}})[-\s]([0-9]{{2}})\s+([0-9]{{1,2}})[:\s]([0-9]{{2}})"
_SKU_SHAPE = r"(?s)\A[A-Za-z0-9]+-[A-Za-z0-9]+-[А-ЯЁа-яё]+(-.*)?\z"


def _none_if_blank(value: Column) -> Column:
    return F.when(value != "", value)


def _longest(runs: Column) -> Column:
    """The longest string of an array, the first of equals; '' for none."""
    return F.aggregate(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))


def _digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))


def digits_of(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _without_zeros(digits: Column) -> Column:
    """Without leading zeros; all zeros give '0'."""
    return F.coalesce(_none_if_blank(F.regexp_replace(digits, "^0+", "")), F.lit("0"))


def parse_quantity(raw: Column) -> Column:
    """The longest run of digits once white space is gone, if positive."""
    number = _longest(_digit_runs(F.regexp_replace(raw, _WHITE, ""))).try_cast("bigint")
    return F.when(number > 0, number)


def parse_total(raw: Column) -> Column:
    """All digits together as a number; null past 64 bits or without digits."""
    return digits_of(raw).try_cast("bigint")


def parse_doc_number(raw: Column) -> Column:
    digits = digits_of(raw)
    return F.when(digits != "", _without_zeros(digits))


def parse_doc_date(raw: Column) -> Column:
    """``yyyy-MM-dd HH:mm``, rebuilt from the first 12 digits where needed."""
    spaced = F.regexp_replace(F.regexp_replace(raw, "[^0-9: -]", " "), " +", " ")
    clean = F.regexp_replace(F.trim(spaced), r":\z", "")
    digits = digits_of(clean)
    cut = [F.substring(digits, at, n) for at, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2))]
    rebuilt = F.concat(cut[0], F.lit("-"), cut[1], F.lit("-"), cut[2], F.lit(" "), cut[3], F.lit(":"), cut[4])
    return F.when(clean.rlike(DOC_DATE), clean).when(F.length(digits) >= 12, rebuilt)


def normalize_sku(raw: Column) -> Column:
    """Joins the lines of a cell by hyphens and drops inner white space."""
    lines = F.transform(F.split(raw, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, _WHITE + "+", " ")))
    lines = F.filter(lines, lambda x: x != "")

    def join(sofar: Column, line: Column) -> Column:
        plain = (sofar == "") | sofar.endswith("-") | line.startswith("-")
        return F.when(plain, F.concat(sofar, line)).otherwise(F.concat(sofar, F.lit("-"), line))

    return _none_if_blank(F.regexp_replace(F.aggregate(lines, F.lit(""), join), _WHITE, ""))


def merge_sku(latin: Column, cyrillic: Column) -> Column:
    """The Latin reading with its third segment from the Cyrillic one."""
    own, other = F.split(latin, "-"), F.split(F.coalesce(cyrillic, F.lit("")), "-")
    third = F.get(other, F.lit(2))
    usable = (F.size(own) == F.size(other)) & (F.size(own) >= 3) & (third != "")
    merged = F.concat_ws("-", F.slice(own, 1, 2), F.array(third), F.slice(own, F.lit(4), F.greatest(F.size(own) - 3, F.lit(0))))
    return F.when(F.coalesce(latin, F.lit("")) == "", cyrillic).when(F.coalesce(usable, F.lit(False)), merged).otherwise(latin)


def valid_sku(sku: Column) -> Column:
    return F.coalesce(sku.rlike(_SKU_SHAPE), F.lit(False))


def doc_number_from_id(doc_id: Column) -> Column:
    return F.when(doc_id.isNotNull(), _without_zeros(F.substring(doc_id, 4, 1 << 20)))


def doc_id_from_number(number: Column) -> Column:
    digits = digits_of(number)
    padded = F.concat(F.lit(f"{DOC_ID_PREFIX}-"), F.lpad(digits, DOC_ID_DIGITS, "0"))
    return F.when((digits != "") & (F.length(digits) <= DOC_ID_DIGITS), padded)


def extract_doc_number(text: Column) -> Column:
    """The longest run of 4 to 10 digits that does not begin with 0."""
    runs = F.filter(_digit_runs(text), lambda r: F.length(r).between(4, DOC_ID_DIGITS) & ~r.startswith("0"))
    return _none_if_blank(_longest(runs))


def _without_first(text: Column, found: Column) -> Column:
    """The text with the first occurrence of ``found`` as one space."""
    at = F.instr(text, found)
    cut = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(found), F.length(text)))
    return F.when((found != "") & (at > 0), cut).otherwise(text)


def parse_header(raw: Column) -> Column:
    """STRUCT<doc_id, doc_date, doc_number> of a header region's text."""
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, r"[\r\n]+", " "), r"\s{2,}", " "))

    def with_id(flat: Column) -> Column:
        shown = F.regexp_extract(flat, _ID_IN_TEXT, 0)
        doc_id = F.concat(F.regexp_extract(flat, _ID_IN_TEXT, 1), F.lit("-"), F.regexp_extract(flat, _ID_IN_TEXT, 2))

        def with_date(rest: Column) -> Column:
            date = F.regexp_extract(rest, _DATE_IN_TEXT, 0)
            part = [F.regexp_extract(rest, _DATE_IN_TEXT, k) for k in range(1, 6)]
            day = F.concat_ws("-", *part[:3])
            full = F.concat(day, F.lit(" "), F.lpad(part[3], 2, "0"), F.lit(":"), part[4])
            return F.struct(
                F.when(shown != "", doc_id).alias("doc_id"),
                F.when(date != "", full).alias("doc_date"),
                extract_doc_number(_without_first(rest, date)).alias("doc_number"),
            )

        return F.get(F.transform(F.array(_without_first(flat, shown)), with_date), F.lit(0))

    return F.get(F.transform(F.array(text), with_id), F.lit(0))


def accept_item_barcode(text: Column) -> Column:
    return F.when(text.rlike(ITEM_BARCODE), text)


def accept_doc_id(text: Column) -> Column:
    return F.when(text.rlike(DOC_ID), text)


def is_network_path(path: Column) -> Column:
    return path.startswith("\\\\") | path.startswith("//")


def is_stale(synced_at: Column, entries: Column, now: Column, max_age_hours: int) -> Column:
    """Empty, undated or older than the limit; dates to come are fresh."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.try_to_timestamp(synced_at))
    return (entries == 0) | F.coalesce(age > max_age_hours * 3_600_000_000, F.lit(True))
