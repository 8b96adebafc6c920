"""Look-alike folding inside the JVM.

Spark has no Unicode normalisation function. ``fold_compat`` covers the part of NFKC that maps one
character to one character with a single ``translate`` whose table is derived from the Unicode data
that ships with Python, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like a Cyrillic letter.
LATIN_AS_CYRILLIC = dict(zip("ABCEHKMOPTXYaceopxykmtbdgirhn", "АВСЕНКМОРТХУасеорхукмтЬԁgіrһп"))
LATIN_AS_CYRILLIC = {a: b for a, b in LATIN_AS_CYRILLIC.items() if a in "ABCEHKMOPTXYaceopxykm"}
GREEK_AS_CYRILLIC = dict(zip("ΑΒΕΗΚΜΟΡΤΧΥΓΠΦανορχκτυ", "АВЕНКМОРТХУГПФачорхкту"))
GREEK_AS_CYRILLIC.pop("ν"), GREEK_AS_CYRILLIC.pop("α")
GREEK_AS_CYRILLIC |= {"α": "а", "ε": "е", "Ϲ": "С", "ϲ": "с"}
# Letters that look like a Latin letter.
CYRILLIC_AS_LATIN = {b: a for a, b in LATIN_AS_CYRILLIC.items()} | dict(zip("ІіЈјЅѕԚԛԜԝ", "IiJjSsQqWw"))
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικυρ", "ABEZHIKMNOPTYXoavikup"))
# Letters that look like a digit.
LETTERS_AS_DIGITS = {**dict.fromkeys("ОоOoΟοО", "0"), **dict.fromkeys("Зз", "3"), **dict.fromkeys("lIІ|Ι", "1"), **dict.fromkeys("Бб", "6")}
# Characters drawn as an ordinary hyphen.
HYPHENS = "‐‑－﹣−­"
DASHES = "‒–—―⁃"
# Composed Cyrillic letters.
COMPOSED = {"й": "й", "Й": "Й", "ё": "ё", "Ё": "Ё", "ї": "ї", "ў": "ў", "Ў": "Ў"}


@cache
def ignorable() -> str:
    """Characters that are drawn as nothing."""
    return "".join(
        c
        for c in map(chr, range(0x80, 0xFFFF))
        if (unicodedata.category(c) == "Cf" and not 0x600 <= ord(c) <= 0x8FF) or c in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= ord(c) <= 0xFE0F
    )


@cache
def odd_spaces() -> str:
    """White space other than the ordinary space and line breaks."""
    return "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs")


@cache
def compat_table() -> dict[str, str]:
    """Characters whose NFKC form is one other character, without ideographs and spaces."""
    out = {}
    for i in (*range(0x80, 0xF900), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(i)
        if unicodedata.category(c) in ("Cn", "Co", "Cs", "Zs", "Lo"):
            continue
        n = unicodedata.normalize("NFKC", c)
        if len(n) == 1 and n != c:
            out[c] = n
    return out


def _literal(pairs: dict[str, str], drop: str = "") -> tuple[str, str]:
    assert all(len(a) == 1 and len(b) == 1 for a, b in pairs.items()) and sys.maxunicode > 0xFFFF
    return "".join(pairs) + drop, "".join(pairs.values())


def drop_ignorable(c: Column) -> Column:
    return F.translate(c, ignorable(), "")


def fold_compat(c: Column) -> Column:
    """One-to-one NFKC, no invisible characters, plain spaces and hyphens, composed Cyrillic."""
    pairs = compat_table() | dict.fromkeys(odd_spaces(), " ") | dict.fromkeys(HYPHENS.replace("­", ""), "-")
    drop = "".join(x for x in ignorable() if x not in pairs)
    pairs = {a: b for a, b in pairs.items() if a not in ignorable()}
    out = F.translate(c, *_literal(pairs, drop))
    for a, b in COMPOSED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def to_cyrillic(c: Column) -> Column:
    """Every Latin or Greek look-alike becomes the Cyrillic letter; for comparison keys only."""
    return F.translate(c, *_literal(LATIN_AS_CYRILLIC | GREEK_AS_CYRILLIC))


def to_digits(c: Column) -> Column:
    return F.translate(c, *_literal(LETTERS_AS_DIGITS))
