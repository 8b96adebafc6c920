"""Dates written by people."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vedomost.functions.fold import fold_compat

# Month names by their first letters.
MONTHS = {
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "мая": 5, "май": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
_ISO = r"(?<!\d)(\d{4})\s*[-./]\s*(\d{1,2})\s*[-./]\s*(\d{1,2})(?!\d)"
_DMY = r"(?<!\d)(\d{1,2})\s*[-./]\s*(\d{1,2})\s*[-./]\s*(\d{4})(?!\d)"
_DMY2 = r"^\D*(\d{1,2})[./](\d{1,2})[./](\d{2})\D*$"
_WORD = rf"(?iu)(?<!\d)(\d{{1,2}})[-\s.]*({'|'.join(MONTHS)})\p{{L}}*[-\s.,]*(\d{{4}})(?!\d)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def _fold(c: Column) -> Column:
    """``fold_compat`` where there is anything to fold."""
    return F.when(c.rlike(r"^[\x20-\x7E]*$"), c).otherwise(fold_compat(c))


def parse_any_date(c: Column) -> Column:
    """The first calendar day written in ``c`` in any usual notation, or NULL.

    Words before and after are allowed; 31.02 is no day; a year or a month alone is none.
    """
    return let(F.regexp_replace(_fold(c), "[‒-―_]", "-"), _parse)


def _parse(t: Column) -> Column:
    def day(pattern: str, order: str) -> Column:  # a cast, unlike a date pattern, throws nothing for 31.02
        return F.regexp_replace(t, "^.*?(?:" + pattern.removeprefix("(?iu)") + ").*$", order).try_cast("date")

    month = F.lit(None).cast("string")
    name = F.lower(F.regexp_extract(t, _WORD, 2))
    for k, v in MONTHS.items():
        month = F.when(name == k, F.lit(str(v))).otherwise(month)
    named = F.concat_ws("-", F.regexp_extract(t, _WORD, 3), month, F.regexp_extract(t, _WORD, 1)).try_cast("date")
    return (
        F.when(~t.rlike(r"\d.*\d"), None)
        .when(t.rlike(_DMY), day(_DMY, "$3-$2-$1"))
        .when(t.rlike(_ISO), day(_ISO, "$1-$2-$3"))
        .when(t.rlike(_WORD), named)
        .when(t.rlike(_DMY2), day(_DMY2, "20$3-$2-$1"))
    )


def blank_to_null(c: Column) -> Column:
    """NULL for text without any visible character."""
    return F.when(c.rlike(r"[\x21-\x7E\u0400-\u04FF]") | (F.trim(F.regexp_replace(fold_compat(c), r"(?U)\s+", " ")) != ""), c)
