"""Differences between two copies of a dataset.

Both sides are unpivoted to (key, field, value) cells, brought together with signed counts and grouped:
cells that both sides hold cancel, what is left is a difference. A cell for the row itself tells a
missing key from a differing one. The first grouping aggregates before its shuffle, so a key with very
many repeated rows arrives as a handful of partial sums; the second sees differences only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vedomost.functions.dates import blank_to_null, let, parse_any_date
from vedomost.functions.fold import fold_compat, to_cyrillic, to_digits

ROW = "\u0000row"
_NUMBER = r"(?U)(?:(?<![^\W_])|(?<=[UuУу]))\d+(?:[\s\-_.]+\d+){2,}(?![^\W_])"


def number_key(c: Column) -> Column:
    """The digit groups of a permit number as written, joined by ``-``; other text folded; NULL for blank.

    Look-alike letters count as the digits they look like; prefix, separators, case and words around
    do not count, leading zeros do.
    """
    return let(F.regexp_replace(fold_compat(c), "[‒-―]", "-"), _number_of_folded)


def _number_of_folded(text: Column) -> Column:
    found = F.regexp_extract(to_digits(text), _NUMBER, 0)
    rest = F.trim(F.regexp_replace(F.lower(to_cyrillic(text)), r"(?U)[\W_]+", " "))
    return F.when(found != "", F.regexp_replace(found, r"[\s\-_.]+", "-")).otherwise(F.nullif(rest, F.lit("")))


def words_key(c: Column) -> Column:
    """The words of ``c`` without case, quotes, dashes, separators, points and look-alike differences; NULL if none."""
    folded = F.translate(F.lower(to_cyrillic(fold_compat(c))), "ё№", "е ")
    folded = F.translate(folded, "aceopxykmt", "асеорхукмт")
    return F.nullif(F.trim(F.regexp_replace(folded, r"(?U)[\W_]+", " ")), F.lit(""))


def day_key(c: Column) -> Column:
    """The calendar day; text that is no day counts as itself, marked; NULL for blank."""
    return let(blank_to_null(c), lambda x: F.coalesce(F.date_format(parse_any_date(x), "yyyy-MM-dd"), F.concat(F.lit("text:"), F.lower(F.trim(x)))))


def latest_rows(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order``; ties are broken by the values, so the result is defined.

    A max over a struct aggregates before the shuffle, unlike a window.
    """
    top = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *columns)).alias("_top")
    return df.groupBy(key).agg(top).select(key, *[F.col(f"_top.{c}").alias(c) for c in columns])


def _cells(df: DataFrame, key: str, fields: Mapping[str, Column], sign: int) -> DataFrame:
    # An exploded array evaluates each key expression once per row; Expand would do so once per field.
    cells = [F.struct(F.lit(ROW).alias("field"), F.lit("").alias("value"))] + [F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in fields.items()]
    return df.select(F.col(key).alias("_key"), F.explode(F.array(*cells)).alias("c")).select("_key", "c.field", "c.value", F.lit(sign).alias("sign"))


def diff_copies(left: DataFrame, right: DataFrame, key: str, left_fields: Mapping[str, Column], right_fields: Mapping[str, Column], multiset: bool = False) -> DataFrame:
    """Rows and cells in which two copies differ.

    ``left_fields`` and ``right_fields`` map the field's name to its comparison key; NULL is an empty cell and
    equals only an empty cell. Result: ``(key, field, n_left, n_right, left_value, right_value)``, field
    NULL where the whole row is missing on one side (then one of the counts is 0). A NULL key is a key
    like any other. With ``multiset`` the numbers of repeated rows must agree as well; without it,
    repeated equal rows count once. Empty inputs give one missing row per key of the other side.
    Columns of the inputs that are not named play no part, so clashing names do no harm.
    """
    if set(left_fields) != set(right_fields):
        raise ValueError("both sides need the same fields")
    cells = _cells(left, key, left_fields, 1).unionByName(_cells(right, key, right_fields, -1))
    counted = cells.groupBy("_key", "field", "value").agg(F.sum(F.when(F.col("sign") > 0, 1).otherwise(0)).alias("n_left"), F.sum(F.when(F.col("sign") < 0, 1).otherwise(0)).alias("n_right"))
    if not multiset:
        counted = counted.withColumns({"n_left": F.least("n_left", F.lit(1)), "n_right": F.least("n_right", F.lit(1))})
    uncancelled = counted.where("n_left <> n_right")
    by_cell = uncancelled.groupBy("_key", "field").agg(
        F.sum("n_left").alias("n_left"),
        F.sum("n_right").alias("n_right"),
        F.min(F.when(F.col("n_left") > F.col("n_right"), F.col("value"))).alias("left_value"),
        F.min(F.when(F.col("n_right") > F.col("n_left"), F.col("value"))).alias("right_value"),
    )
    whole = by_cell.groupBy("_key").agg(
        F.max(F.struct((F.col("field") == ROW).alias("is_row"), "n_left", "n_right")).alias("row"),
        F.collect_list(F.struct("field", "n_left", "n_right", "left_value", "right_value")).alias("cells"),  # at most one entry per field
    )
    missing = F.col("row.is_row") & (F.least("row.n_left", "row.n_right") == 0)
    kept = F.when(missing, F.filter("cells", lambda x: x.field == ROW)).otherwise(F.filter("cells", lambda x: x.field != ROW) if not multiset else F.col("cells"))
    out = whole.select(F.col("_key").alias(key), F.explode(kept).alias("c"))
    return out.select(key, F.when(F.col("c.field") != ROW, F.col("c.field")).alias("field"), "c.n_left", "c.n_right", "c.left_value", "c.right_value")


def register_copy_diff(register: DataFrame, copy: DataFrame) -> DataFrame:
    """Differences of the register and its copy: ``(reg_id, diff)``.

    Of the copy only the row with the latest ``synced_at`` counts (ties: the greatest copy_id). NULL and
    blank values are equal. A text of the copy that is no existing day differs from any day and from none.
    """
    latest = latest_rows(copy, "reg_id", ["synced_at", "copy_id"], ["number", "end_date", "builder"])
    fields = {"number": number_key(F.col("number")), "builder": words_key(F.col("builder")), "end_date": day_key(F.col("end_date"))}
    stored = fields | {"end_date": F.date_format("end_date", "yyyy-MM-dd")}  # a DATE column
    found = diff_copies(register, latest, "reg_id", stored, fields)
    kind = F.when(F.col("field").isNotNull(), F.col("field")).when(F.col("n_left") > 0, "missing_in_copy").otherwise("missing_in_register")
    return found.select("reg_id", kind.alias("diff"))
