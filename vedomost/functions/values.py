"""Dates, numbers, digests, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vedomost.functions.text import OBJECT_DATE
from vedomost.operators.merge import day


def valid_days(texts: Column) -> Column:
    """struct(valid, any_invalid) of an array of dd.mm.yyyy texts, order kept."""
    return F.struct(F.filter(texts, lambda x: day(x).isNotNull()).alias("valid"), F.exists(texts, lambda x: day(x).isNull()).alias("any_invalid"))


def latest_day(texts: Column) -> Column:
    """The text of the latest existing day; the first of equal ones; NULL if none."""
    return F.array_max(F.transform(F.filter(texts, lambda x: day(x).isNotNull()), lambda x: F.struct(day(x).alias("d"), x.alias("t"))))["t"]


def add_months(text: Column, months: Column) -> Column:
    """A day so many months later, clamped to the month's end."""
    return F.date_format(F.add_months(day(text), months), "dd.MM.yyyy")


def days_in(c: Column) -> Column:
    """All date tokens of a text, in order."""
    return F.regexp_extract_all(c, F.lit(OBJECT_DATE), F.lit(1))


def clamp_round(c: Column) -> Column:
    """A confidence within 0..100, to one digit, halves to even."""
    return F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c)), 1)


def canonical_digest(m: Column) -> Column:
    """SHA-256 of a map as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), 256)


def overlay(base: Column, top: Column) -> Column:
    """Two maps in one; where both have a key, ``top`` wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)


def count_filled(*columns: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
