"""Visually identical text with different characters, brought to one consistent form.

Every character has a set of scripts it is used in (its script extensions; digits, marks and signs go with all). The sets of a
token, a run of letters and marks, are intersected: an empty intersection is a mixed-script token. A second intersection takes in the scripts in
which a letter has a look-alike: it tells in which scripts the token could be spelled, so a token of one script that could be spelled
in another as well is a whole-script confusable. The token belongs in the only script that can spell it; where several can, the corpus decides: the
script in which the same skeleton is written more often. Remaining forms (full width, decomposed accents, invisible
characters, odd spaces and hyphens, letters among digits) are normalised.

Tokens that nothing has to be decided about (letters of one alphabet, one of them without look-alike) are left out inside the JVM; scripts are resolved
once per distinct other token. Corpus counts are aggregated before their shuffle and cover all rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vedomost.functions.fold import CYRILLIC_AS_LATIN, GREEK_AS_CYRILLIC, GREEK_AS_LATIN, HYPHENS, LATIN_AS_CYRILLIC, LETTERS_AS_DIGITS, compat_table, fold_compat, ignorable, odd_spaces

# The scripts in common use, and the scripts written together with another.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Georgian", "Hebrew", "Arabic", "Syriac", "Thaana", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Tibetan", "Myanmar", "Ethiopic", "Khmer", "Mongolian", "Han", "Hiragana", "Katakana", "Bopomofo", "Hangul", "Cherokee", "Coptic", "Glagolitic", "Gothic", "Deseret", "Lisu", "Tifinagh", "Runic", "Ogham")
TOGETHER = {"Han": ("Japanese", "Korean", "Chinese"), "Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Hangul": ("Korean",), "Bopomofo": ("Chinese",)}
# Letters of further scripts that look like a Latin letter.
OTHERS_AS_LATIN = dict(zip("օոսհցյՕՍՏԼՅᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃⲞⲟⲤⲥⲢⲣⲨ", "onuhgjOUSLJABCDEGHJKLMPRSTVWZOoCcPpY"))
#: For each script that tokens are rewritten to, the characters that look like one of its letters.
LOOKALIKES = {"Cyrillic": LATIN_AS_CYRILLIC | GREEK_AS_CYRILLIC, "Latin": CYRILLIC_AS_LATIN | GREEK_AS_LATIN | OTHERS_AS_LATIN}
LOOKALIKES["Cyrillic"] |= {o: c for o, latin in OTHERS_AS_LATIN.items() if (c := LATIN_AS_CYRILLIC.get(latin))}
_SCRIPT = {s: regex.compile(rf"\p{{scx={s}}}") for s in SCRIPTS}
_EVERY = frozenset({*SCRIPTS, *(t for ts in TOGETHER.values() for t in ts)})
_DIGIT_LIKE = "".join(c for c in LETTERS_AS_DIGITS if c != "|")
AMONG_DIGITS = rf"\d[{_DIGIT_LIKE}]|[{_DIGIT_LIKE}]\d|(?<=[-–_ ])[{_DIGIT_LIKE}]{{1,4}}(?=[-–_ ]|$)"
#: In running text a letter counts as a digit between digits only.
BETWEEN_DIGITS = rf"\d[{_DIGIT_LIKE}]+\d"
_CYR, _LAT = "А-Яа-яЁё", "A-Za-z"
_UNLIKE_CYR = "".join(c for c in map(chr, [*range(0x410, 0x450), 0x401, 0x451]) if c not in CYRILLIC_AS_LATIN)
_UNLIKE_LAT = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if c not in LATIN_AS_CYRILLIC)
#: A token with something to decide: not one alphabet with a letter that has no look-alike.
TOKEN = rf"(?<![\p{{L}}\p{{M}}])(?!(?:[{_CYR}]*[{_UNLIKE_CYR}][{_CYR}]*|[{_LAT}]*[{_UNLIKE_LAT}][{_LAT}]*)(?![\p{{L}}\p{{M}}]))\p{{L}}[\p{{L}}\p{{M}}]*"
#: Compatibility characters with a plain meaning of their own.
KEPT = "№…«»–"


@lru_cache(65_536)
def scripts_of(char: str) -> frozenset[str]:
    """The scripts a character is used in; all of them for digits, marks and signs."""
    own = {s for s, pattern in _SCRIPT.items() if pattern.match(char)}
    return frozenset(own.union(*(TOGETHER.get(s, ()) for s in own))) if own else _EVERY


@lru_cache(65_536)
def _spellings(char: str) -> frozenset[str]:
    """The scripts that have the character or one that looks like it."""
    return scripts_of(char) | {s for s, table in LOOKALIKES.items() if char in table}


def resolve_token(token: str) -> tuple[frozenset[str], frozenset[str]]:
    """(scripts common to all characters of the token, scripts that can spell it); no common script means mixed."""
    common, can = _EVERY, _EVERY
    for c in token:
        common, can = common & scripts_of(c), can & _spellings(c)
    return common, can


def spelled(token: str, script: str) -> str:
    """The token with its look-alikes of another script replaced."""
    return "".join(c if script in scripts_of(c) else LOOKALIKES[script].get(c, c) for c in token)


def odd_form(c: Column) -> Column:
    """Whether a character is a compatibility form, invisible, an odd space or hyphen, or a detached accent."""
    odd = "".join(dict.fromkeys([*compat_table(), *ignorable(), *odd_spaces(), *HYPHENS]))
    odd = "".join(x for x in odd if x not in KEPT)
    # translate looks characters up in a hash table; a regex class of two thousand characters would try one after the other
    return c.rlike(r"[^\x00-\x7FА-яЁё" + KEPT + "]") & ((F.translate(c, odd, "") != c) | c.rlike("[\u0300-\u036F]"))


def token_fixes(tokens: DataFrame) -> DataFrame:
    """``(scope, token, script)`` of each distinct token that is not written in the one script it belongs in.

    ``tokens``: (scope, token), one row per occurrence. Mixed tokens always have a row, with a NULL script where none can
    spell them. Ties go to Cyrillic. A token of a script that has no look-alikes elsewhere has none.
    """
    counts = tokens.groupBy("scope", "token").agg(F.count("*").alias("n"))

    @F.pandas_udf("struct<mixed:boolean,own:string,can:array<string>,skeleton:string>")
    def resolve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for token in batch.array:
                common, can = resolve_token(token)
                plain = [s for s in LOOKALIKES if s in can]
                out.append((not common, next((s for s in LOOKALIKES if s in common), None), plain, spelled(token, "Cyrillic")))
            yield pd.DataFrame(out, columns=["mixed", "own", "can", "skeleton"])

    c = counts.withColumn("r", resolve("token")).select("scope", "token", "n", "r.*").where("mixed OR size(can) > 0")
    same = Window.partitionBy("scope", "skeleton")  # the spellings of one skeleton, a handful
    written = {s: F.sum(F.when(F.col("own") == s, F.col("n")).otherwise(0)).over(same) for s in LOOKALIKES}
    c = c.withColumns({f"n_{s}": w for s, w in written.items()})
    most = F.when(F.col("n_Cyrillic") >= F.col("n_Latin"), "Cyrillic").otherwise("Latin")
    c = c.withColumn("script", F.when(F.size("can") > 1, most).otherwise(F.try_element_at("can", F.lit(1))))
    return c.where(F.col("mixed") | ~F.col("script").eqNullSafe(F.col("own"))).select("scope", "token", "script")


def lookalike_values(values: DataFrame) -> DataFrame:
    """The values with a character that looks like, or hides beside, the plain one.

    ``values``: (tab, row_id, scope, value), scope ``number`` or ``object``. Result: (tab, row_id, scope,
    value, fixes), fixes a map from token to script (NULL for a mixed token that no script can spell); one row per different input
    row. NULL and empty values are never reported; a value of spaces only if a space is odd. Repeated rows count once.
    """
    value, number = F.col("value"), F.col("scope") == "number"
    ascii_number = value.rlike(r"^[-0-9RUru№_ –]*$")
    own = F.when(number, F.regexp_replace("value", AMONG_DIGITS, "0")).otherwise(F.regexp_replace("value", rf"(?<=\d)[{_DIGIT_LIKE}]+(?=\d)", "0"))
    found = F.array_distinct(F.regexp_extract_all(F.when(odd_form(own), fold_compat(own)).otherwise(own), F.lit(TOKEN), F.lit(0)))
    tokens = values.where("value IS NOT NULL").select("tab", "row_id", "scope", "value", F.explode(found).alias("token"))
    by_token = tokens.join(token_fixes(tokens), ["scope", "token"]).select("tab", "row_id", "scope", "value", F.struct("token", "script").alias("fix"))
    digits = F.when(number, ~ascii_number & fold_compat(value).rlike(AMONG_DIGITS)).otherwise(value.rlike(BETWEEN_DIGITS))
    by_form = values.where(odd_form(value) | digits).select("tab", "row_id", "scope", "value", F.lit(None).cast("struct<token:string,script:string>").alias("fix"))
    both = by_form.unionByName(by_token).groupBy("tab", "row_id", "scope", "value").agg(F.collect_set("fix").alias("fixes"))  # a value's tokens
    return both.select("tab", "row_id", "scope", "value", F.map_from_entries("fixes").alias("fixes"))


def plain_text(value: str, scope: str = "object", fixes: dict[str, str] | None = None) -> str:
    """The consistent form of one value; equal-looking values get equal forms."""
    kept = {c: chr(0xE000 + i) for i, c in enumerate(KEPT)}
    text = "".join(kept.get(c, c) for c in value if c not in ignorable())
    text = unicodedata.normalize("NFKC", text.translate({ord(h): "-" for h in HYPHENS}))
    text = text.translate({ord(v): k for k, v in kept.items()})
    among = rf"(?<![^\W\d_])(?:RU)?[\d{_DIGIT_LIKE}]*\d[\d{_DIGIT_LIKE}]*(?![^\W\d_])|(?<=[-–_ ])[{_DIGIT_LIKE}]{{1,4}}(?=[-–_ ]|$)"
    text = re.sub(among if scope == "number" else rf"(?<=\d)[{_DIGIT_LIKE}]+(?=\d)", lambda m: "".join(LETTERS_AS_DIGITS.get(c, c) for c in m[0]), text)

    def token(m: re.Match) -> str:
        can = [s for s in LOOKALIKES if s in resolve_token(m[0])[1]]
        script = can[0] if len(can) == 1 else (fixes or {}).get(m[0]) if can else None
        return spelled(m[0], script) if script else m[0]

    return unicodedata.normalize("NFC", regex.sub(r"\p{L}[\p{L}\p{M}]*", token, text))


def canonical_values(flagged: DataFrame) -> DataFrame:
    """``lookalike_values`` with the plain form of each value: (tab, row_id, value, plain)."""

    @F.pandas_udf("string")
    def plain(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, s, f in batches:
            yield pd.Series([plain_text(x, y, dict(z)) for x, y, z in zip(v, s, f)], dtype="object")

    return flagged.select("tab", "row_id", "value", plain("value", "scope", "fixes").alias("plain"))


def permit_values(register: DataFrame, copy: DataFrame, records: DataFrame) -> DataFrame:
    """Numbers of the register and its copy and objects of the records, as ``lookalike_values`` takes them."""

    def part(df: DataFrame, tab: str, row_id: str, scope: str) -> DataFrame:
        return df.select(F.lit(tab).alias("tab"), F.col(row_id).cast("long").alias("row_id"), F.lit(scope).alias("scope"), F.col(scope).alias("value"))

    return part(register, "register_rows", "reg_id", "number").unionByName(part(copy, "register_copy", "copy_id", "number")).unionByName(part(records, "rns_records", "rec_id", "object"))
