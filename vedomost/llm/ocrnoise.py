"""Noise in text from scanned pages, found and repaired.

Running headers, footers and page numbers are what repeats at one height on the pages of a scan: the heights at which
lines repeat, above and below all others, are the margins. Body lines are written once as lists of tokens; whatever depends on a token alone (its word,
whether its characters are possible, its corrections) is decided once per distinct token.

A frequency lexicon is counted over all body lines, without the pieces of divided words. A symmetric-delete index, keyed by
confusion classes instead of letters, with one letter left out on either side, gives each word its correction candidates; a weighted edit
distance over substitutions, lost and added letters and joined signs, cheap for confusion pairs, ranks them by cost against frequency. Words with
characters that no word has and without a candidate in the lexicon take the cheapest reading of their characters. Among possible words the
bigrams with the words before and after decide. Words divided at a line's end are found by their mark, or by
pieces that are no words while the whole is one.

Lines are ordered within a page, pages within a scan by one row each, so a scan with very many lines is no single task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vedomost.session import cut_lineage, small, spread

# What recognition writes, and the printed letters it may stand for.
CONFUSED = {"0": "о", "с": "ое", "п": "нлцк", "и": "нвмйкп", "e": "ес", "€": "е", "a": "ая", "@": "а", "я": "а", "p": "р", "ф": "р", "m": "т", "г": "т", "н": "икп", "n": "ип", "й": "ин", "c": "с", "е": "со", "(": "с", "д": "л", "k": "к", "8": "в", "л": "пдн", "g": "д", "v": "у", "y": "у", "3": "зэ", "э": "з", "r": "яг", "4": "ч", "т": "г", "*": "ж", "6": "б", "щ": "ш", "ш": "щ", "o": "о", "x": "х", "b": "в", "h": "н", "t": "т", "u": "и", "о": "с", "в": "8", "з": "э", "1": "л", "l": "л"}
# Two signs for one letter.
JOINED = (("bl", "ы"), ("ьi", "ы"), ("ьl", "ы"), ("ь1", "ы"), ("rn", "м"), ("ii", "й"), ("эк", "ж"), ("10", "ю"), ("l0", "ю"), ("lo", "ю"))
NOISE = "`'.|"
MARKS = "-¬­‐‑–"
# Thresholds: a height belongs to the margins if this share of its lines repeats on another page; heights with less than one in STRAY of
# the lines of the fullest height tell nothing.
REPEATED, STRAY = 0.2, 100
_OUTER = "«»\"“”„.,;:!?)…—|"
RATIO, SURE_RATIO = 2, 8
# The weights of a confusion, of a sign that is no letter, and of any other edit; the letters that the longer word needs for one of those.
CONFUSION, SIGN, OTHER_EDIT, LONG = 1.0, 1.5, 8.0, 5
# The digits that letters and signs in a number stand for.
NUMERALS = {"l": "1", "I": "1", "|": "1", "i": "1", "z": "2", "Z": "2", "o": "0", "O": "0", "о": "0", "О": "0", "?": "7", "s": "5", "S": "5", "З": "3", "з": "3", "э": "3", "Э": "3", "Б": "6", "б": "6", "ч": "4", "Ч": "4", "в": "8", "В": "8"}
_CYR = "а-яё"


def _classes() -> dict[str, str]:
    """Each character's confusion class: the least of all characters reachable by confusions."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, printed in CONFUSED.items():
        for b in printed:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {c: find(c) for c in parent}


CLASSES = _classes()


def skeleton(word: str) -> str:
    for pair, letter in JOINED:
        word = word.replace(pair, letter)
    return "".join(CLASSES.get(c, c) for c in word if c not in NOISE)


def misreading_cost(seen: str, printed: str) -> float | None:
    """The least weight of edits that make ``seen`` of ``printed``; None if that takes two edits that are no confusions, or one in a short word.

    A confusion pair and a joined sign weigh CONFUSION, a sign of noise for a letter or added SIGN, any other substitution, a
    lost and an added letter OTHER_EDIT.
    """
    n, m = len(seen), len(printed)
    most = OTHER_EDIT * 2 if max(n, m) >= LONG else OTHER_EDIT
    if abs(n - m) > 3:
        return None
    rows = [[j * OTHER_EDIT for j in range(m + 1)]]  # j letters lost
    for i in range(1, n + 1):
        a, up = seen[i - 1], rows[-1]
        added = SIGN if a in NOISE else OTHER_EDIT
        row = [up[0] + added]
        pair = seen[i - 2 : i] if i > 1 else ""
        for j in range(1, m + 1):
            b = printed[j - 1]
            if a == b:
                cost = up[j - 1]
            elif b in CONFUSED.get(a, ""):
                cost = up[j - 1] + CONFUSION
            else:
                cost = up[j - 1] + (SIGN if a in NOISE else OTHER_EDIT)
            if pair and (pair, b) in _JOINED:
                cost = min(cost, rows[-2][j - 1] + CONFUSION)
            row.append(min(cost, up[j] + added, row[j - 1] + OTHER_EDIT))
        if min(row) >= most:
            return None
        rows.append(row)
    return rows[-1][-1] if rows[-1][-1] < most else None


_JOINED = frozenset(JOINED)
_LEFT, _RIGHT = re.compile(rf"^[{re.escape(_OUTER)}]+|^\((?=[А-ЯЁ0-9])"), re.compile(rf"[{re.escape(_OUTER + MARKS)}]+$")
_NUMBER = re.compile(r"[\d.,:/%-]*\d[\d.,:/%-]*")
_BARE = re.compile(r"^[«»\"“”„(]+|[«»\"“”„.,;:!?)…—]+$")  # a bar stays: it stands for a 1
_HAS_CYRILLIC = re.compile("[А-Яа-яЁё]")
_FOREIGN = re.compile(r"[A-Za-z€@*`'|]|[А-Яа-яЁё][(0-9]|[0-9][А-Яа-яЁё]{3}|\([а-яё]*$|[а-яё]{2}\.[а-яё]|[а-яё]\.[а-яё]{2}|[а-яё]{2}[А-ЯЁ]")
_ORDINAL = re.compile(r"№?\d+[-–]?[а-яё]{1,2}")
_NUMERIC = re.compile(r"(?:RU[-–])?[0-9lI|zZoO?SsоОзЗБбчЧвВэЭ.,:/–-]+")
_SEVERAL = re.compile(r"\d.*[.,:/-].*\d|\d\D?\d\D?\d")
_LETTERED = re.compile(r"[lI|zZoOSsоОзЗБбчЧвВэЭ]|\?[\d.,:/-]|\d{2}\.\d{2}\.\d{0,3}\?")
_QUOTED = re.compile(r"[`'@€]")
_INITIALS = re.compile(r"[«(]?(?:[А-ЯЁ]\.){1,3}[,;]?")


def word_of(text: str) -> str:
    """A token's word: lower case, without outer punctuation; numbers count as one word ``#``."""
    word = _RIGHT.sub("", _LEFT.sub("", text)).lower()
    return "#" if _NUMBER.fullmatch(word) else word


def reading(text: str) -> str | None:
    """The cheapest reading of a token whose characters no word or number has; None where they are possible.

    Signs inside a word are dropped, foreign letters, digits and signs become the first letter they are confused with, letters in a
    number become digits.
    """
    bare = _BARE.sub("", text)
    if _NUMERIC.fullmatch(bare) and _SEVERAL.search(bare) and _LETTERED.search(bare.removeprefix("RU")):
        head = "RU" if bare.startswith("RU") else ""
        return head + "".join(NUMERALS.get(c, c) for c in bare[len(head) :])
    odd = bool(_HAS_CYRILLIC.search(bare)) and _FOREIGN.search(bare) and not _ORDINAL.fullmatch(bare)
    if not (odd or (_QUOTED.search(bare) and any(c.isalnum() for c in bare)) or re.search(r"[а-яё]\($", text)):
        return None
    word = bare.lower()
    for pair, letter in JOINED:
        if pair.isascii():
            word = word.replace(pair, letter)
    if not _HAS_CYRILLIC.search(word):  # a sign among letters of another alphabet is added
        return "".join(c for c in word if c not in NOISE + "@€") or None
    return "".join(c if _HAS_CYRILLIC.match(c) or c == "-" else CONFUSED.get(c, "")[:1] for c in word)


def body_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with words, each with ``furniture``: whether it lies in the margins, where lines repeat on the pages of a scan.

    Heights are hundredths of the page. Pages without a height have no margins, nor has a corpus without body lines.
    """
    top = F.array_min(F.transform("words", lambda w: w.top))
    low = F.array_max(F.transform("words", lambda w: w.top + w.height))
    bin_ = F.when(F.col("page_height") > 0, F.floor((top + low) * 50 / F.col("page_height")).cast("int"))
    filled = lines.where(F.size("words") > 0).select("line_id", "scan_id", "page", "line_no", "words", bin_.alias("bin"))
    pattern = F.xxhash64(F.regexp_replace(F.array_join(F.transform("words", lambda w: w.text), " "), r"\d+", "#"))
    same = filled.where("bin IS NOT NULL").groupBy("scan_id", "bin", pattern.alias("p")).agg(F.count("*").alias("n"), (F.min("page") < F.max("page")).alias("again"))
    heights = same.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)).alias("again"))  # a hundred rows
    most = heights.agg(F.max("n").alias("most"))
    body = (F.col("again") < REPEATED * F.col("n")) & (F.col("n") * STRAY >= F.col("most"))
    edges = heights.withColumn("_k", F.lit(1)).join(F.broadcast(most.withColumn("_k", F.lit(1))), "_k").where(body).agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    j = filled.withColumn("_k", F.lit(1)).join(F.broadcast(edges.withColumn("_k", F.lit(1))), "_k", "left")  # one row
    furniture = F.coalesce((F.col("bin") < F.col("first")) | (F.col("bin") > F.col("last")), F.lit(False))
    return j.select("line_id", "scan_id", "page", "line_no", "words", furniture.alias("furniture"))


def token_lines(flagged: DataFrame) -> DataFrame:
    """Body lines, each line_id once, as tokens, with what the next body line of the scan begins with.

    Result: line_id, scan_id, page, line_no, t (tokens), indent (whether the line is indented), next (line_id, first, second, indent) or NULL.
    """
    body = flagged.where("NOT furniture").repartition("scan_id", "page").dropDuplicates(["scan_id", "page", "line_no", "line_id"])
    first = F.element_at("words", 1)
    slim = body.select("line_id", "scan_id", "page", "line_no", F.transform("words", lambda w: F.coalesce(w.text, F.lit(""))).alias("t"), first["left"].alias("left"), first["height"].alias("height"))
    page = Window.partitionBy("scan_id", "page")
    slim = slim.withColumn("indent", F.coalesce(F.col("left") - F.min("left").over(page) >= F.col("height"), F.lit(False)))
    begins = F.struct("line_id", F.element_at("t", 1).alias("first"), F.try_element_at("t", F.lit(2)).alias("second"), "indent")
    slim = slim.withColumn("begins", begins).withColumn("next", F.lead("begins").over(page.orderBy("line_no", "line_id")))
    slim = cut_lineage(slim.select("line_id", "scan_id", "page", "line_no", "t", "indent", "begins", "next"))
    heads = slim.groupBy("scan_id", "page").agg(F.min_by("begins", F.struct("line_no", "line_id")).alias("head"))  # one row per page
    turns = heads.select("scan_id", "page", F.lead("head").over(Window.partitionBy("scan_id").orderBy("page")).alias("over")).where("over IS NOT NULL")
    last = slim.where("next IS NULL").drop("next").join(turns, ["scan_id", "page"], "left").withColumnRenamed("over", "next")
    return slim.where("next IS NOT NULL").unionByName(last).drop("begins")


def token_table(slim: DataFrame) -> DataFrame:
    """``(t, w, reading, n, n_a, n_b)`` of each distinct token: its word, the reading of impossible characters, all its occurrences,
    those before a line's last word and those after its first.

    A first piece of a divided word stands last in its line and a second piece first, so ``n_a`` and ``n_b`` tell how often they are words.
    """

    @F.pandas_udf("struct<w:string,reading:string>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"w": [word_of(x) for x in b.array], "reading": pd.Series([reading(x) for x in b.array], dtype="object")})

    real = F.filter("t", lambda x: x.rlike(r"[\p{L}\p{N}]"))
    each = slim.select(real.alias("t")).select(F.size("t").alias("size"), F.posexplode("t").alias("i", "t"))
    seen = each.groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("i") < F.col("size") - 1).alias("n_a"), F.count_if(F.col("i") > 0).alias("n_b"))
    return cut_lineage(seen.withColumn("p", parts("t")).select("t", "p.w", "p.reading", "n", "n_a", "n_b"))


def place_counts(tokens: DataFrame) -> DataFrame:
    """``(w, n, n_a, n_b)`` of each word."""
    return tokens.where("w <> ''").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "n_a", "n_b")])


def _column_word(text: Column) -> Column:
    outer = "".join("\\" + c for c in _OUTER)
    return F.lower(F.regexp_replace(text, rf"^[{outer}]+|[{outer}{MARKS}]+$|^\((?=[А-ЯЁ0-9])", ""))


def divided_words(slim: DataFrame, counts: DataFrame) -> DataFrame:
    """``(line_id, word_no, next_line_id, joined, before, end, begin, after)`` of words that go on in the next body line.

    ``end`` and ``begin`` are the tokens of the pieces, ``before`` and ``after`` their neighbours. ``counts`` is ``place_counts``, materialised.
    """
    alone = (F.size("t") > 1) & F.element_at("t", -1).rlike(rf"^[{MARKS}]$")
    at = F.when(alone, F.size("t") - 1).otherwise(F.size("t"))
    p = slim.where("next IS NOT NULL").select("line_id", at.alias("word_no"), alone.alias("apart"), F.element_at("t", at).alias("end"), F.try_element_at("t", F.when(at > 1, at - 1)).alias("before"), F.when(alone, F.element_at("t", -1)).otherwise("").alias("sign"), "next")
    p = p.select("*", F.concat("end", "sign").alias("last"))
    p = p.where(F.col("next.first").rlike(rf"^[{_CYR}]") & F.col("last").rlike(rf"[{_CYR}]"))
    mark = F.col("last").rlike(rf"[{MARKS}]$")
    p = p.withColumns({"mark": mark, "a": _column_word(F.regexp_replace("last", rf"[{MARKS}]+$", "")), "b": _column_word(F.regexp_replace("next.first", rf"[{MARKS}]+$", ""))})
    p = p.where(F.col("a").rlike(rf"^[{_CYR}(-]*[{_CYR}]$"))
    closed = F.col("last").rlike(rf"[{_OUTER}][{MARKS}]*$".replace("|", ""))
    p = p.withColumns({"joined": F.concat("a", "b"), "hyphen": F.col("last").rlike(r"[-‐‑–]$"), "open": ~F.col("mark") & ~closed & ~F.col("next.indent")})
    known = small(counts)
    p = p.join(known.select(F.col("w").alias("joined"), F.col("n").alias("n_joined")), "joined", "left").fillna(0, ["n_joined"])
    p = p.where(F.col("mark") | (F.col("open") & (F.col("n_joined") >= 2))).withColumn("linked", F.concat_ws("-", "a", "b"))

    def look(df: DataFrame, column: str, n: str) -> DataFrame:
        return df.join(known.select(F.col("w").alias(column), F.col(n).alias(f"n_{column}"), F.col("n").alias(f"all_{column}")), column, "left").fillna(0, [f"n_{column}", f"all_{column}"])

    p = look(look(look(p, "linked", "n"), "a", "n_a"), "b", "n_b")
    own_word = lambda x: F.col(f"n_{x}") > 2 * F.greatest(F.col(f"all_{x}") - F.col(f"n_{x}"), F.lit(1))  # noqa: E731  # mostly where it can be no piece
    unknown = (F.col("n_linked") == 0) & (F.col("n_joined") == 0) & (~F.col("apart") | (F.col("n_a") == 0)) & ~(own_word("a") & own_word("b"))
    marked = F.col("mark") & (~F.col("hyphen") | (F.col("n_joined") > F.col("n_linked")) | unknown)
    unmarked = F.col("open") & (F.col("n_joined") >= 2) & (F.least("n_a", "n_b") * 20 <= F.col("n_joined"))
    return p.where(marked | unmarked).select("line_id", "word_no", F.col("next.line_id").alias("next_line_id"), "joined", "before", "end", F.col("next.first").alias("begin"), F.col("next.second").alias("after"))


def _open_ends(slim: DataFrame, split: DataFrame) -> DataFrame:
    """``(before, end)`` of the lines whose last token is a piece or goes on behind a mark, and ``(begin, after)`` of the second pieces, as pairs ``(x, y, piece)``."""
    marked = slim.where(F.element_at("t", -1).rlike(rf"[^{MARKS}][{MARKS}]$")).select("line_id", F.when(F.size("t") > 1, F.element_at("t", F.size("t") - 1)).alias("x"), F.element_at("t", -1).alias("y"))
    ends = split.select("line_id", F.col("before").alias("x"), F.col("end").alias("y")).unionByName(marked).distinct().select("x", "y", F.col("y").alias("piece"))
    begins = split.select(F.col("begin").alias("x"), F.col("after").alias("y"), F.col("begin").alias("piece"))
    return ends.unionByName(begins)


def lexicon(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(w, n)``: the words of all body lines, without the pieces of divided words."""
    gone = pieces.groupBy(F.col("piece").alias("t")).agg(F.count("*").alias("gone")).join(tokens.select("t", "w"), "t").groupBy("w").agg(F.sum("gone").alias("gone"))
    all_ = tokens.where("w <> ''").groupBy("w").agg(F.sum("n").alias("n"))
    return all_.join(gone, "w", "left").select("w", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")).where("n > 0")


def candidates(counts: DataFrame) -> DataFrame:
    """``(w, c, cost, n, n_c)``: for each word the more frequent words that it may be a misreading of.

    ``counts(w, n)``. The words and the lexicon are indexed by their confusion skeletons, whole and with one letter left out, on both sides:
    equal keys serve confusions in any number, signs of noise and one lost, added or other letter.
    """

    @F.pandas_udf("array<string>")
    def index_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([list(dict.fromkeys([s, *(s[:i] + s[i + 1 :] for i in range(len(s)))])) for s in map(skeleton, b.array)], dtype="object")

    @F.pandas_udf("double")
    def cost(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([misreading_cost(x, y) for x, y in zip(a.array, b.array)], dtype="float64")

    words = counts.where(F.col("w").rlike(rf"^[{_CYR}A-Za-z0-9€@*(`'.|-]+$") & F.col("w").rlike(rf"[{_CYR}A-Za-z]"))
    keyed = cut_lineage(words.withColumn("keys", index_keys("w")).withColumn("clean", F.col("w").rlike(f"^(?:[{_CYR}]+(?:-[{_CYR}]+)*|[a-z]+(?:-[a-z]+)*)$")))
    # the bound is no count: a word once printed is no evidence for another one, at any size
    index = keyed.where("clean AND n > 1").select(F.col("w").alias("c"), F.col("n").alias("n_c"), F.explode("keys").alias("key"))
    asked = keyed.select("w", "n", F.col("keys")[0].alias("whole"), F.explode("keys").alias("key"), F.col("w").rlike(r"[`'.|]|rn|bl|ь[il1]|ii|эк|[1l]0|lo").alias("noisy"))
    far = (F.col("n_c") >= SURE_RATIO * F.col("n")) & (F.abs(F.length("w") - F.length("c")) <= F.when(F.col("noisy"), 3).otherwise(1)) & ((F.greatest(F.length("w"), F.length("c")) >= LONG) | F.col("noisy"))
    near = (F.col("key") == F.col("whole")) & (F.col("noisy") | (F.length("w") == F.length("c")))
    pairs = asked.join(index, "key").where((F.col("n_c") >= RATIO * F.col("n")) & (F.col("w") != F.col("c")) & (near | far)).select("w", "c", "n", "n_c").distinct()
    costed = spread(pairs, "w").withColumn("cost", cost("w", "c")).where("cost IS NOT NULL AND NOT isnan(cost)")
    return costed.where((F.col("cost") < OTHER_EDIT) | ((F.col("cost") < OTHER_EDIT + 2) & (F.col("n_c") >= SURE_RATIO * F.col("n"))))


def misread_words(slim: DataFrame, tokens: DataFrame, counts: DataFrame, pieces: DataFrame, split: DataFrame) -> DataFrame:
    """``(line_id, word_no, w, repair)`` of the words whose characters are not those printed."""
    seen = tokens.where("w <> '' AND w <> '#'").select("w").distinct().join(counts, "w", "left").select("w", F.coalesce("n", F.lit(1)).alias("n"))
    best = candidates(seen).groupBy("w").agg(F.max_by(F.struct("c", "n", "n_c", "cost"), F.struct(F.log("n_c") - 3 * F.col("cost"), F.col("n_c"), F.col("c"))).alias("b")).select("w", "b.*")
    sure = (F.col("n_c") >= SURE_RATIO * F.col("n")) & (F.col("cost") < OTHER_EDIT) & ((F.length("w") > 3) | F.col("w").rlike(r"[^а-яё]"))
    fixes = tokens.select("t", "w", "reading").join(best.withColumn("sure", sure), "w", "left").where("reading IS NOT NULL OR c IS NOT NULL")
    initials = F.col("t").rlike(f"^{_INITIALS.pattern}$")
    certain = F.col("reading").isNotNull() | F.col("sure")
    fixes = cut_lineage(fixes.where(~initials).select("t", "w", "c", "cost", certain.alias("certain"), F.coalesce("c", "reading").alias("repair")))
    each = slim.select("line_id", "t", F.posexplode("t").alias("i", "x"))
    each = each.select("line_id", F.col("x").alias("t"), (F.col("i") + 1).alias("word_no"), F.coalesce(F.get("t", F.col("i") - 1), F.lit("")).alias("before_t"), F.coalesce(F.get("t", F.col("i") + 1), F.lit("")).alias("after_t"))
    hits = cut_lineage(each.join(small(fixes), "t"))
    told = hits.where("certain").select("line_id", "word_no", "w", "repair").unionByName(_by_context(hits.where("NOT certain"), slim, tokens, pieces))
    taken = split.select("line_id", "word_no").unionByName(split.select(F.col("next_line_id").alias("line_id"), F.lit(1).alias("word_no"))).distinct()
    return told.join(taken, ["line_id", "word_no"], "left_anti")


def _by_context(asked: DataFrame, slim: DataFrame, tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """Of possible words with a candidate, those whose neighbours go with the candidate much more often than with the word.

    Only bigrams that are asked for are counted, over all body lines, without pieces of divided words.
    """
    words = small(tokens.select("t", "w"))
    name = lambda side: words.select(F.col("t").alias(f"{side}_t"), F.col("w").alias(side))
    asked = asked.join(name("before"), "before_t", "left").join(name("after"), "after_t", "left").fillna("", ["before", "after"])
    context = asked.select("w", "c", "cost", "before", "after").distinct()
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")) for k, x, y in (("bw", "before", "w"), ("bc", "before", "c"), ("wa", "w", "after"), ("ca", "c", "after"))])
    quests = cut_lineage(context.select("*", F.inline(keys)))
    wanted = quests.select("x", "y").distinct()
    follow = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))), lambda i: F.struct(F.try_element_at("t", i).alias("x_t"), F.try_element_at("t", i + 1).alias("y_t")))
    pairs = slim.where(F.size("t") > 1).select(F.inline(follow), F.lit(1).alias("k"))
    pairs = pairs.unionByName(pieces.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").alias("x_t"), F.col("y").alias("y_t"), F.lit(-1).alias("k")))
    counted = pairs.groupBy("x_t", "y_t").agg(F.sum("k").alias("n"))
    counted = counted.join(name("x"), "x_t").join(name("y"), "y_t").groupBy("x", "y").agg(F.sum("n").alias("n")).where("n > 1")
    bigrams = counted.join(wanted, ["x", "y"])
    got = quests.join(bigrams, ["x", "y"], "left")
    one = lambda k: F.max(F.when(F.col("k") == k, F.coalesce("n", F.lit(0)))).alias(k)
    weighed = got.groupBy("w", "c", "cost", "before", "after").agg(one("bw"), one("bc"), one("wa"), one("ca"))
    left = (F.col("before") != "") & (F.col("bc") >= SURE_RATIO * F.greatest("bw", F.lit(1)))
    right = (F.col("after") != "") & (F.col("ca") >= SURE_RATIO * F.greatest("wa", F.lit(1)))
    against = ((F.col("before") != "") & (F.col("bw") > F.col("bc"))) | ((F.col("after") != "") & (F.col("wa") > F.col("ca")))
    all_sides = left & right  # an edit that is no confusion may be an inflection: it needs both neighbours
    told = weighed.where((left | right) & ~against & ((F.col("cost") < OTHER_EDIT) | all_sides)).select("w", "c", "before", "after")
    return asked.join(told, ["w", "c", "before", "after"]).select("line_id", "word_no", "w", F.col("c").alias("repair"))


def scan_noise(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines with furniture flags, body lines as tokens, divided words, misread words) of scanned lines."""
    flagged = body_lines(lines)
    slim = token_lines(flagged)
    tokens = token_table(slim)
    split = cut_lineage(divided_words(slim, cut_lineage(place_counts(tokens))).distinct())
    pieces = cut_lineage(_open_ends(slim, split))
    return flagged, slim, split, misread_words(slim, tokens, lexicon(tokens, pieces), pieces, split)


def found_noise(lines: DataFrame) -> DataFrame:
    """``(line_id, word_no, kind)`` of each divided word, misread word and furniture line; repeated lines count once.

    Lines without words have no row; NULL words are skipped but keep their number; empty tables give no row.
    """
    flagged, _, split, misread = scan_noise(lines)
    furniture = flagged.where("furniture").select("line_id", F.lit(0).alias("word_no"), F.lit("furniture").alias("kind")).distinct()
    return furniture.unionByName(split.select("line_id", "word_no", F.lit("split").alias("kind"))).unionByName(misread.select("line_id", "word_no", F.lit("misread").alias("kind")).distinct())


def paragraphs(lines: DataFrame) -> DataFrame:
    """``(scan_id, page, first_line, text)``: continuous readable paragraphs of each scan.

    Furniture is left out, divided words are joined, misread words are repaired. A paragraph begins at an indented
    line; it is listed under the page on which it begins. Lines are numbered within their page and pages within their scan, so only a
    paragraph's own lines meet in one row.
    """
    _, slim, split, misread = scan_noise(lines)
    repairs = misread.where("repair IS NOT NULL").groupBy("line_id", "word_no").agg(F.min("repair").alias("repair")).groupBy("line_id").agg(F.map_from_entries(F.collect_list(F.struct("word_no", "repair"))).alias("repairs"))  # words of a line
    ends = split.groupBy("line_id").agg(F.max(F.struct("word_no", "joined")).alias("end"))
    drops = split.select(F.col("next_line_id").alias("line_id"), F.lit(True).alias("drop")).distinct()
    full = slim.select("scan_id", "page", "line_no", "line_id", "t", "indent").join(repairs, "line_id", "left").join(ends, "line_id", "left").join(drops, "line_id", "left")

    def shown(text: Column, i: Column) -> Column:
        fix = F.try_element_at(F.col("repairs"), (i + 1).cast("int"))
        cased = F.when(F.regexp_extract(text, r"\p{L}", 0).rlike(r"\p{Lu}"), F.initcap(fix)).otherwise(fix)
        repaired = F.when(fix.isNotNull(), F.concat(F.regexp_extract(text, r"^[«\"“„(]*", 0), cased, F.regexp_extract(text, r"[».,;:!?)…\"”]*$", 0))).otherwise(text)
        ending = F.col("end").isNotNull() & (i + 1 == F.col("end.word_no"))
        whole = F.when(ending, F.when(text.rlike(r"^\p{Lu}"), F.initcap("end.joined")).otherwise(F.col("end.joined"))).otherwise(repaired)
        gone = (F.coalesce("drop", F.lit(False)) & (i == 0)) | (F.col("end").isNotNull() & (i + 1 > F.col("end.word_no")))
        return F.when(~gone, whole)

    text = F.array_join(F.filter(F.transform("t", shown), lambda x: x.isNotNull() & (x != "")), " ")
    local = F.sum(F.col("indent").cast("int")).over(Window.partitionBy("scan_id", "page").orderBy("line_no", "line_id"))
    told = full.select("scan_id", "page", "line_no", "line_id", text.alias("text"), local.alias("local"))
    starts = slim.groupBy("scan_id", "page").agg(F.sum(F.col("indent").cast("int")).alias("starts"))  # one row per page
    before = F.coalesce(F.sum("starts").over(Window.partitionBy("scan_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = told.join(starts.select("scan_id", "page", before.alias("before")), ["scan_id", "page"]).withColumn("para", F.col("before") + F.col("local"))
    joined = numbered.groupBy("scan_id", "para").agg(F.min(F.struct("page", "line_no")).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "line_id", "text"))), lambda x: x.text), " ").alias("text"))
    return joined.select("scan_id", "at.page", F.col("at.line_no").alias("first_line"), "text")
