"""Best representative of each duplicate group, field by field.

Every field of every record becomes one long row with a normalised value. A value's votes are the sum
over its records of source trust times recency decay; per group and field the value with the most votes
wins (``max_by`` on a struct with a total order) and the winners are pivoted back to one row per group.

A vote halves with every half-life that it is older, down to 2 to the minus many billions where the half-life is a
fraction of a second and the data span years. So votes are summed in logarithmic form: the age in half-lives is cut into
buckets of ``SPAN``, the votes of a bucket are summed as doubles, and of a value's buckets the newest and its neighbour give
the logarithm of the whole sum (what is older is beyond a double's precision). One code path serves every half-life.

Votes are aggregated before each shuffle, so a group that holds a third of all rows arrives as its distinct
spellings. Cut-off names are found without pairs: among the sorted distinct spellings of a group, a spelling is
a proper prefix of some other one exactly if it is a prefix of its successor. Rows travel as (time, row id) in one decimal, which
hash aggregates; the winners' texts are fetched by row id afterwards, where they are asked for.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vedomost.functions.dates import let, parse_any_date
from vedomost.functions.fold import ignorable, odd_spaces

# Fillers that stand for a missing name, after lower() and without outer points and brackets.
PLACEHOLDERS = ("нет данных", "см приложение", "не указано", "не указан", "не определён", "не определен", "пусто", "б/н", "уточняется", "прочерк", "xxx", "ххх", "н/д", "согласно титульному листу", "не заполнено", "отсутствует", "нет", "неизвестно", "null", "none", "n/a")
CUT_MARK = r"\s*(?:…|\.\.\.|[-‐‑–])$"
LEAST_NAME = 4


@dataclass(frozen=True)
class FieldRule:
    """How a field's values are read: ``kind`` is ``date`` or ``name``; ``trust`` is the weight of a row's value, 0 never wins."""

    kind: str
    trust: Column


_DROPPED = "«»\"“”„‟'‘’" + ignorable()


def _name_norm(c: Column) -> Column:
    """A spelling without case, quotes, invisible characters and repeated spaces; NULL for fillers and blanks."""
    spaces = odd_spaces() + "\t\r\n"
    plain = F.translate(F.lower(c), "ё" + spaces + _DROPPED, "е" + " " * len(spaces))

    def norm(x: Column) -> Column:
        tidy = F.trim(F.when(F.instr(x, "  ") > 0, F.regexp_replace(x, " {2,}", " ")).otherwise(x))
        bare = F.trim(F.regexp_replace(x, r"[^0-9A-Za-z\u0400-\u04FF/ ]", ""))
        real = let(bare, lambda y: ~y.isin(*dict.fromkeys(p.replace("ё", "е") for p in PLACEHOLDERS)) & y.rlike(r"\p{L}") & (F.length(y) >= LEAST_NAME - 1))
        return F.when((F.length(x) >= 30) | real, tidy)

    return let(plain, norm)


def _uncut(c: Column) -> Column:
    """(the value without a mark that it was cut off, whether it had one)."""
    cut = F.endswith(c, F.lit("…")) | F.endswith(c, F.lit("...")) | F.endswith(c, F.lit("-")) | F.endswith(c, F.lit("‐")) | F.endswith(c, F.lit("–"))
    return F.struct(F.when(cut, F.regexp_replace(c, CUT_MARK, "")).otherwise(c).alias("bare"), cut.alias("cut"))


#: Half-lives in one bucket of votes; a bucket's sum stays a finite double for any number of rows.
SPAN = 512
#: A half-life under which, of votes a second or more apart, the latest outweighs all earlier ones together.
LATEST_WINS = 0.01 / 86_400
_ROW_DIGITS = Decimal("10000000000000000000")


def _long(records: DataFrame, group: str, row_id: str, order: str, fields: Mapping[str, FieldRule]) -> DataFrame:
    """One row per record and field: _group, _row, _at (microseconds), place (of the field), norm, trust."""

    def cell(i: int, name: str, rule: FieldRule) -> Column:
        value = F.col(name).cast("string")
        if rule.kind == "date":
            norm, trust = F.date_format(parse_any_date(value), "yyyy-MM-dd"), rule.trust.cast("double")
        else:
            norm, trust = _name_norm(_uncut(F.rtrim(value))["bare"]), F.when(_uncut(F.rtrim(value))["cut"], 0.0).otherwise(rule.trust.cast("double"))
        return F.struct(F.lit(i).cast("tinyint").alias("place"), norm.alias("norm"), F.coalesce(trust, F.lit(0.0)).alias("trust"))

    at = F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(0))
    cells = F.array(*[cell(i, n, r) for i, (n, r) in enumerate(fields.items())])
    return records.select(F.col(group).alias("_group"), F.col(row_id).cast("long").alias("_row"), at.alias("_at"), F.inline(cells))


def _log_votes(even: tuple[Column, Column], odd: tuple[Column, Column]) -> Column:
    """log2 of a value's votes from its newest even and odd bucket and their sums.

    The newest bucket's neighbour has the other parity, and if it is there at all it is the newest of its parity.
    """
    (e, se), (o, so) = even, odd
    newest = F.greatest(e, o)  # NULL counts as nothing
    top, low = F.when(newest == e, se).otherwise(so), F.when(newest == e, so).otherwise(se)
    near = F.coalesce(F.abs(e - o) == 1, F.lit(False))
    return newest * F.lit(float(SPAN)) + F.log2(top + F.when(near, low * F.pow(F.lit(2.0), F.lit(-float(SPAN)))).otherwise(0.0))


def resolve_fields(records: DataFrame, group: str, row_id: str, order: str, fields: Mapping[str, FieldRule], half_life_days: float) -> DataFrame:
    """One surviving value per group and field.

    ``order`` is a timestamp, ``row_id`` a whole number from 0. The decay halves a vote every ``half_life_days`` (a millisecond at least). Result:
    one row per group with ``_n_rows_differ`` (it has two different row ids) and per field a struct ``(row_id, votes)``: the latest
    record with the value that has the most votes, and their binary logarithm; NULL if no value is usable: NULL, blank, a filler,
    no calendar day, a cut-off form of another value of the group, or trust 0. Ties go to the later, then the greater row
    id. A repeated row votes again. A NULL group is a group; an empty table gives no row. Further columns are ignored.
    """
    half = round(half_life_days * 86_400_000_000)
    if half < 1_000:
        raise ValueError("half_life_days under a millisecond")
    width = half * SPAN
    trusted = (F.col("trust") > 0) & F.col("norm").isNotNull()
    bucket = F.floor(F.col("_at") / F.lit(width)) if width >= 1 << 52 else (F.col("_at") - F.pmod("_at", F.lit(width))) / F.lit(width)
    names = [i for i, r in enumerate(fields.values()) if r.kind == "name"]
    # a name that is not trusted can still show another one to be cut off; other cells without a vote say nothing
    telling = F.col("norm").isNotNull() & ((F.col("trust") > 0) | F.col("place").isin(*names))
    long = _long(records, group, row_id, order, fields).where(telling).withColumn("bucket", F.when(trusted, bucket.cast("long")))
    weight = F.col("trust") * F.pow(F.lit(2.0), F.pmod("_at", F.lit(width)) / F.lit(float(half)))
    key = F.col("_at").cast("decimal(17,0)") * F.lit(_ROW_DIGITS) + F.col("_row").cast("decimal(19,0)")
    parts = long.groupBy("_group", "place", "norm", "bucket").agg(
        F.sum(F.when(trusted, weight)).alias("s"), F.max(F.when(trusted, key.cast("decimal(38,0)"))).alias("last")
    )
    even, odd = F.pmod("bucket", F.lit(2)) == 0, F.pmod("bucket", F.lit(2)) == 1
    votes = parts.groupBy("_group", "place", "norm").agg(
        F.max(F.when(even, F.col("bucket"))).alias("e"),
        F.max_by("s", F.when(even, F.col("bucket"))).alias("se"),
        F.max(F.when(odd, F.col("bucket"))).alias("o"),
        F.max_by("s", F.when(odd, F.col("bucket"))).alias("so"),
        F.max("last").alias("last"),
    )
    votes = votes.select("_group", "place", "norm", _log_votes((F.col("e"), F.col("se")), (F.col("o"), F.col("so"))).alias("votes"), "last")
    if names:
        start = F.substring("norm", 1, LEAST_NAME)
        after = F.lead("norm").over(Window.partitionBy("_group", "place", start).orderBy("norm"))
        is_name = F.col("place").isin(*names) & F.col("norm").isNotNull()
        cut = is_name & (F.coalesce(F.startswith(after, "norm"), F.lit(False)) | (F.length("norm") < LEAST_NAME))
        votes = votes.withColumn("cut", F.coalesce(cut, F.lit(False)))
    else:
        votes = votes.withColumn("cut", F.lit(False))
    usable = ~F.col("cut") & F.col("last").isNotNull()
    score = F.struct("votes", "last")
    won = votes.where(usable).groupBy("_group").agg(*[F.max(F.when(F.col("place") == i, score)).alias(n) for i, n in enumerate(fields)])
    groups = records.groupBy(F.col(group).alias("_all")).agg((F.min(row_id) != F.max(row_id)).alias("_n_rows_differ"))
    won = groups.join(won, F.col("_all").eqNullSafe(F.col("_group")), "left")
    row = lambda n: F.pmod(F.col(f"{n}.last"), F.lit(_ROW_DIGITS)).cast("long")
    cells = [F.when(F.col(n).isNotNull(), F.struct(row(n).alias("row_id"), F.col(f"{n}.votes").alias("votes"))).alias(n) for n in fields]
    return won.select(F.col("_all").alias(group), "_n_rows_differ", *cells)


def _permit_rules() -> dict[str, FieldRule]:
    def trust(field: str) -> Column:
        status = F.col("field_quality")[field]["status"]
        return F.when(F.coalesce(status, F.lit("")) == "review", 0.0).otherwise(1.0)

    return {"end_date": FieldRule("date", trust("end")), "changed": FieldRule("date", trust("changed")), "issuer": FieldRule("name", trust("issuer")), "builder": FieldRule("name", trust("builder"))}


def permit_survivors(records: DataFrame, half_life_days: float = LATEST_WINS) -> DataFrame:
    """The surviving end_date, changed, issuer and builder of each permit with two records or more."""
    return resolve_fields(records, "number", "rec_id", "received_at", _permit_rules(), half_life_days).where("_n_rows_differ").drop("_n_rows_differ")


def survivor_cells(survivors: DataFrame) -> DataFrame:
    """``permit_survivors`` as ``(number, field, rec_id)``, one row per field that has a value."""
    fields = list(_permit_rules())
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.row_id").alias("rec_id")) for f in fields])
    return survivors.select("number", F.explode(cells).alias("c")).select("number", "c.field", "c.rec_id").where("rec_id IS NOT NULL")


def survivor_values(survivors: DataFrame, records: DataFrame) -> DataFrame:
    """``survivor_cells`` pivoted back to one record per permit with the winners' texts: ``(number, end_date, changed, issuer, builder)``.

    A field without a usable value is NULL. The texts are fetched by permit and record id from records that are read a second time.
    """
    fields = list(_permit_rules())
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    told = records.select(F.col("rec_id").cast("long").alias("rec_id"), F.inline(texts)).groupBy("rec_id", "field").agg(F.max("value").alias("value"))
    asked = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.row_id").alias("rec_id")) for f in fields])
    cells = survivors.select("number", F.inline(asked)).join(told, ["rec_id", "field"], "left")
    return cells.groupBy("number").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
