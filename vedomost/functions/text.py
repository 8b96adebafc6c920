"""Text functions: normal forms, comparison keys, identities, cleaning.

Unicode NFKC and case folding run in the JVM through the ICU library that Spark ships for collations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vedomost.functions.dates import let

# Fixed value: a date token.
OBJECT_DATE = r"(\d{2}\.\d{2}\.20\d{2})"
SPACE = r"(?U)[\s\x1c-\x1f]+"
EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def nfkc(c: Column) -> Column:
    """Unicode NFKC; NULL stays NULL. ASCII text is returned as it is."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)))


def casefold(c: Column) -> Column:
    """Full Unicode case folding (unlike lower(), ß becomes ss)."""
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE, "")


def normalize_text(c: Column, fold: bool = True) -> Column:
    """NFKC, plain spaces, ё as е, one space between words; NULL for blank; folded case unless ``fold`` is off."""
    text = F.trim(F.regexp_replace(F.translate(nfkc(c), "ёЁ ", "еЕ "), SPACE, " "))
    return F.nullif(casefold(text) if fold else text, F.lit(""))


def compare_key(c: Column) -> Column:
    """What two texts must share to be equal but for presentation; '' for NULL and blank."""
    text = F.translate(F.coalesce(normalize_text(c), F.lit("")), "«»„“”\"'", "")
    text = F.regexp_replace(text, "[‐‑‒–—−]", "-")
    text = F.regexp_replace(text, r"(?iuU)\b(\d+(?:[.,]\d+)?)\s*(?:кв|kb)\b", "$1 кв")
    text = F.regexp_replace(text, r"(?iuU)\b(\d+(?:[.,]\d+)?)\s*мва\b", "$1 мва")
    return F.btrim(text, F.lit(" .,;:"))


# Fixed value: the preamble of object names that means nothing, as a comparison key.
GENERIC_PREAMBLE = "обустройство ковыктинского газоконденсатного месторождения"
_STAGE = r"(?U)\bэтап\s+\d+(?:\s*\.\s*\d+)*\b"


def object_key(c: Column) -> Column:
    """``compare_key`` of an object name without the generic preamble right before its first stage."""

    def without(key: Column) -> Column:
        at = F.regexp_instr(key, F.lit(_STAGE))
        head = F.btrim(F.substring(key, F.lit(1), at - 1), F.lit(" .,;:-"))
        return F.when((at > 0) & (head == GENERIC_PREAMBLE), F.substring(key, at, F.length(key))).otherwise(key)

    return let(compare_key(c), without)


def field_key(field: str, c: Column) -> Column:
    """What two values of a field must share to be equal."""
    return object_key(c) if field == "object" else compare_key(c)


# The three ways a permit number is written; look-alike letters count in the prefix only.
LEGACY_NUMBER = r"(?<![0-9A-Za-zА-Яа-я])(?:38|3[ВB]|З8)[\s_\-–—]*(\d{1,2})[\s_\-–—]*(\d{1,2})[\s_\-–—]*(20\d{2})(?!\d)"
COMPACT_NUMBER = r"(?<!\d)(?:38|3[ВB]|З8)(\d{1,2})(\d{1,2})(20\d{2})(?!\d)"
MODERN_NUMBER = r"(?<![0-9A-Za-zА-Яа-я])(?:RU|R[УY]|Р[УY])[\s_\-–—]*(\d{8})[\s_\-–—]*(\d{2})[\s_\-–—]*(20\d{2})(?!\d)"
_GRAMMARS = [(re.compile(p, re.IGNORECASE), prefix) for p, prefix in ((LEGACY_NUMBER, "38"), (COMPACT_NUMBER, "38"), (MODERN_NUMBER, "RU"))]


def identities_of(text: str | None) -> list[str]:
    """The permit numbers in a normalised text, in order of their place, each once."""
    found = sorted(((m.start(), k, "-".join((prefix, *m.groups()))) for k, (g, prefix) in enumerate(_GRAMMARS) for m in g.finditer(text or "")), key=lambda x: x[:2])
    return list(dict.fromkeys(x[2] for x in found))


def _identities(c: Column) -> Column:
    @F.pandas_udf("array<string>")  # made here: the type needs a session, which workers that import this lack
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([identities_of(x) for x in b.array], dtype="object")

    return ids(c)


def identities(c: Column) -> Column:
    """All complete permit numbers in ``c``, ordered by place, without repeats; empty for NULL.

    The grammars overlap and are ordered by offset over one another, which no built-in expresses: one Arrow
    function, fed with text that the JVM has normalised.
    """
    return _identities(normalize_text(F.replace(c, F.lit("№"), F.lit(" ")), fold=False))


def single(ids: Column) -> Column:
    """The only element, else NULL."""
    return F.when(F.size(ids) == 1, ids[0])


def clean_field(c: Column) -> Column:
    """A form value without page marks, bars and outer punctuation; NULL for blank."""
    text = F.regexp_replace(c, r"[\x00\f]+", " ")
    text = F.regexp_replace(text, r"(?iuU)(?:страниц[аы]|лист)\s*\d+(?:\s*(?:из|/|\s)\s*\d+)?", " ")
    text = F.regexp_replace(text, r"(?U)(^|\s)\|+\s*", "$1")
    text = F.btrim(F.regexp_replace(text, SPACE, " "), F.lit(" .,:;-"))
    return F.nullif(F.regexp_replace(text, r"(?U)(?<=\w)-\s+(?=\w)", "-"), F.lit(""))


def clean_district(c: Column) -> Column:
    """``clean_field`` without wording around the district; a lone adjective gets its noun."""
    text = clean_field(c)
    # What is removed, in this order.
    for pattern, by in (
        (r"(?iuU)^округ,?\s+(?=[А-ЯЁ])", ""),
        (r"(?iuU)^иркутская\s+область\s+", ""),
        (r"(?iuU)\s+(?:в\s+)?составе$", ""),
        (r"(?iuU)\s+в$", ""),
        (r"(?iuU)\s+муниципальн\w*\s+район\w*$", " район"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return let(text, lambda t: F.when(t.rlike(r"^[А-ЯЁ][А-Яа-яЁё-]+(?:ский|ской|цкий|цкой)$"), F.concat(t, F.lit(" район"))).otherwise(t))


def first_capture(c: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches, else NULL."""
    return F.coalesce(*[F.when(c.rlike("(?isuU)" + p), F.regexp_extract(c, "(?isuU)" + p, 1)) for p in patterns])


def whole_match(c: Column, pattern: str) -> Column:
    """The whole match on one line without outer punctuation, else NULL."""
    found = F.regexp_extract(c, "(?isuU)" + pattern, 0)
    return F.when(c.rlike("(?isuU)" + pattern), F.btrim(F.regexp_replace(found, SPACE, " "), F.lit(" .,;")))


def quality_tokens(c: Column) -> Column:
    return F.regexp_extract_all(casefold(c), F.lit(r"(?U)[\wЁё]+"), F.lit(0))


def lines_of(c: Column) -> Column:
    """Lines of a text; a line break at the very end adds no empty line, NULL and '' have none."""
    parts = F.split(c, r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(let(parts, lambda p: F.when(p[F.size(p) - 1] == "", F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)))


def document_title(c: Column) -> Column:
    """The first three lines that are not blank, 600 characters at most; '' for NULL."""
    kept = F.filter(lines_of(F.coalesce(c, F.lit(""))), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]"))
    return F.substring(F.array_join(F.slice(kept, 1, 3), "\n"), 1, 600)


def cell_text(c: Column, is_date: bool = False) -> Column:
    """A register cell as text: dates as dd.mm.yyyy, other values without outer space."""
    return F.date_format(c, "dd.MM.yyyy") if is_date else strip(c.cast("string"))


def merge_status(existing: Column, issues: Column) -> Column:
    """A status text with its generated lines replaced by ``issues``; notes of the operator stay; NULL if nothing is left."""
    kept = F.filter(lines_of(F.coalesce(existing, F.lit(""))), lambda x: ~_starts_with_any(x))
    return F.nullif(F.array_join(F.array_distinct(F.concat(issues, kept)), "\n"), F.lit(""))


def _starts_with_any(x: Column) -> Column:
    from vedomost.schemas import SYSTEM_STATUS

    out = F.lit(False)
    for prefix in SYSTEM_STATUS:
        out = out | x.startswith(prefix)
    return out


def transfer_issue(field: str, existing: Column, proposed: Column) -> Column:
    """Why a value was not transferred; NULL if it was or there was nothing to transfer to a filled cell's harm."""
    from vedomost.schemas import LABELS

    label = LABELS[field]
    empty = existing.isNull() | (existing == "")
    return (
        F.when(proposed.isNull() & empty, F.lit(f"Не перенесено «{label}»: значение не найдено в PDF."))
        .when(proposed.isNull(), F.concat(F.lit(f"Не подтверждено «{label}»: значение не найдено в PDF; значение Excel «"), existing, F.lit("» сохранено.")))
        .when(empty | (field_key(field, existing) == field_key(field, proposed)), None)
        .otherwise(F.concat(F.lit(f"Не перенесено «{label}»: в Excel — «"), existing, F.lit("», в PDF — «"), proposed, F.lit("»; значение Excel сохранено.")))
    )


def append_warning(warning: Column, fragment: Column) -> Column:
    """``fragment`` appended to a warning unless it is in it; empty warnings become the fragment."""
    return F.when(warning.isNull() | (warning == ""), fragment).when(F.instr(warning, fragment) > 0, warning).otherwise(F.concat(warning, F.lit(" "), fragment))


def remove_warning(warning: Column, fragment: str) -> Column:
    """A warning without ``fragment``: the whole, an ending, a beginning, or its first occurrence; NULL if nothing is left."""
    f = F.lit(fragment)
    n = len(fragment)
    rest = (
        F.when(warning == f, F.lit(""))
        .when(F.endswith(warning, F.lit(" " + fragment)), F.substring(warning, F.lit(1), F.length(warning) - n - 1))
        .when(F.startswith(warning, F.lit(fragment + " ")), F.substring(warning, F.lit(n + 2), F.length(warning)))
        .otherwise(F.regexp_replace(warning, "(?s)^(.*?)" + re.escape(fragment), "$1"))
    )
    return F.nullif(F.trim(rest), F.lit(""))


def edit_value(field: Column, value: Column) -> Column:
    """A manual edit: struct(value, error). Empty clears; dates become dd.mm.yyyy; text loses outer space."""
    from vedomost.schemas import DATE_FIELDS, TRANSFER_FIELDS

    day = F.coalesce(F.try_to_date(value, "d.M.yyyy"), F.try_to_date(value, "yyyy-M-d"))
    bad = (F.length(value) > 32_767) | value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\uD800-\uDFFF￾￿]")
    clear = value.isNull() | (value == "")
    error = (
        F.when(~field.isin(*TRANSFER_FIELDS) | field.isNull(), "field_not_allowed").when(clear, None).when(bad, "invalid_text").when(field.isin(*DATE_FIELDS) & day.isNull(), "invalid_date")
    )
    result = F.when(error.isNotNull() | clear, None).when(field.isin(*DATE_FIELDS), F.date_format(day, "dd.MM.yyyy")).otherwise(strip(value))
    return F.struct(result.alias("value"), error.alias("error"))
