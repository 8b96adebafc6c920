"""Sentence units of documents in many languages and scripts.

A text is read in lines: headings, form and table lines, list items and notes are units of their own, lines of running
text are joined over line breaks inside a sentence. Running text is divided at the terminators of each script. Whether a point
ends a sentence is decided in the document's own terms first: a word that the document writes with a point
before a small letter is an abbreviation, one that it writes without a point only is none. Where the document shows
nothing or both, the counts of the whole corpus tell; a list of usual abbreviations is the last prior. A capital after an
abbreviation begins a sentence only behind abbreviations that can end one, or if the document writes the capitalised word
small elsewhere, so that it is no name; initials end one only behind their surname.

A decision looks back over the words before it only, so the time is in proportion to the text, whatever its lines.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that stand before what they belong to, and such as may end a sentence.
LEADING = set("ул д стр им п пп ст ч рис см вх исх т табл гл акт пл пер пос просп наб корп оф кв тел разд прил гр проф акад инж зам ср напр вкл обл dr mr mrs ms prof fig figs sec vol no nos cf approx i e g st eq ch pp p art ref vs डॉ श्री".split())
CLOSING = set("мес пр др тыс млн млрд руб коп м км см мм га кг чел экз шт мин сек час гг н е к п ltd inc co corp jr a.m p.m u.s etc".split())
#: Learned abbreviations that travel to the workers; more of them are joined to the documents that have them.
MAX_BROADCAST = 200_000
#: Unambiguous places that make a word of up to SHORT letters, or a longer one, an abbreviation of its document.
SHORT, SHOWN, SHOWN_LONG = 5, 1, 2
LOOK_BACK = 256
OPEN, CLOSE = "«„“「『《〈", "»“”」』》〉"
PAIRS = {"«": "»", "„": "“”", "“": "”“", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "（": "）", '"': '"'}
STOPS = ".!?…"
FULL = "。！？｡"
OTHERS = "।॥؟։۔።፧"
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_ITEM = re.compile(r"(?:[•‣▪◦●*·–-]\s|\(?\d{1,3}\)\s|[а-яa-z]\)\s)")
_NUMBERED = re.compile(r"(?:\d{1,3}\.){1,4}\s+[^\W\d_]")
_HEADING = re.compile(r"(?:раздел|глава|статья|приложение|section|chapter|article|annex|appendix|part)\s+(?:№\s*)?\d", re.I)
_LABEL = re.compile(r"[^\W\d_][^:.!?«»\"“”|]{0,60}:\s+(?:до\s+\d|[\dA-ZА-ЯЁ№—-])")
_NOTE = re.compile(r"[^\W\d_]+\s+№?\s*\d+:\s")
_POINTED = re.compile(r"(?<![^\W_])([^\W\d_]+)\.(?=[  ][a-zа-яё]|,)")
_UNPOINTED = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?=[\s,;:!?)»])")
WRAP = 40


def visible(c: str) -> bool:
    return not (c.isspace() or unicodedata.category(c) in ("Cf", "Cc", "Zs", "Zl", "Zp") or c == "͏")


@lru_cache(100_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0].split("-")[0]


def _strip(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and not visible(text[start]):
        start += 1
    while end > start and not visible(text[end - 1]):
        end -= 1
    return start, end


def _ended(line: str) -> bool:
    """Whether a line ends with a terminator, closing marks aside."""
    bare = line.rstrip("»“”\"')）」』】")
    return bool(bare) and bare[-1] in STOPS + FULL + OTHERS + ";"


class Splitter:
    """Sentence units of one text after the other, with the corpus' abbreviations."""

    def __init__(self, learned: frozenset[str] = frozenset()):
        self.learned = learned

    def units(self, text: str) -> list[tuple[int, int]]:
        """(start, end) offsets of the units, in order; none for a blank text."""
        self.text = text
        out: list[tuple[int, int]] = []
        lines, at = [], 0
        for m in _BREAK.finditer(text):
            lines.append(_strip(text, at, m.start()))
            at = m.end()
        lines.append(_strip(text, at, len(text)))
        self._read_document(text)
        run: list[tuple[int, int]] = []

        def flush() -> None:
            if run:
                out.extend(self._running(run[0][0], run[-1][1]))
                run.clear()

        for i, (a, b) in enumerate(lines):
            if a >= b:
                flush()
                continue
            line = text[a:b]
            goes_on = bool(run) and not self._closed(run[-1])
            after = lines[i + 1] if i + 1 < len(lines) else (0, 0)
            following = text[after[0] : after[1]]
            if goes_on and self._continues(text[run[-1][0] : run[-1][1]], line):
                run.append((a, b))
            elif self._alone(line, following):
                flush()
                out.append((a, b))
            else:
                if goes_on or (run and line[0].islower()):
                    flush()
                run.append((a, b))
        flush()
        return out

    def _closed(self, span: tuple[int, int]) -> bool:
        """Whether a line of running text ends with the end of a sentence."""
        line = self.text[span[0] : span[1]]
        if not _ended(line):
            return False
        m = re.search(r"([^\W\d_]+)\.$", line)
        return not (m and self._abbreviation(m[1]) and m[1].lower() not in CLOSING - {"тыс", "млн", "млрд"} and not (m[1] == "г" and re.search(r"\d\s*г\.$", line)))

    def _continues(self, before: str, line: str) -> bool:
        """Whether an unfinished line goes on in the next one."""
        if _ITEM.match(line) or " | " in line:
            return False
        first = line[0]
        if _script(first) == "THAI":
            return False
        if first.islower() or first in ",;:—–)»”" or (not first.isupper() and first.isalpha()):
            return len(before) >= (WRAP if first.islower() else 20) or not _ended(before) and before[-1] in ",:—" or bool(re.search(r"[^\W\d_]\.$", before))
        return len(before) >= WRAP and (bool(re.search(r"[,:—(«№]$|\.$", before)) or bool(re.search(r"[.!?…]\s+\S", before)) or bool(re.search(r"\s(?:[а-яa-z]{1,3}|ООО|АО|ПАО|ИП)$", before)))

    def _alone(self, line: str, following: str) -> bool:
        """Whether a line that begins no running text is a unit of its own."""
        if " | " in line or _ITEM.match(line) or _NUMBERED.match(line) or _NOTE.match(line):
            return True
        if _HEADING.match(line) and not _ended(line):
            return True
        if _LABEL.match(line) and not re.search(r"[!?…]$", line) and len(line) <= 200:
            value = line.split(":", 1)[1]
            return not re.search(r"[^\W\d_]{4,}[.!?…]\s+\S", value) and (not line.endswith(".") or bool(re.search(r"(?:\d\s*г|\b\w)\.$", line)))
        letter = next(filter(str.isalpha, line), None)
        if letter is None:
            return True
        if _script(letter) == "THAI":
            return False
        if _ended(line):
            return False
        if line[0].islower():
            return True
        if not following:
            return len(line) < WRAP or not re.search(r"[.!?…]\s+\S", line)
        return not (following[0].islower() and len(line) >= WRAP) and not re.search(r"[.!?…]\s+\S|,$", line) and not (line[0].isalpha() and not line[0].isupper())

    def _read_document(self, text: str) -> None:
        """What the document itself shows: words with a point inside a sentence, words without one, words written small."""
        shown: dict[str, int] = {}
        for m in _POINTED.finditer(text):
            low = m[1].lower()
            shown[low] = shown.get(low, 0) + 1
        self.own = {w for w, n in shown.items() if n >= (SHOWN if len(w) <= SHORT else SHOWN_LONG)}
        self.plain = self.small = None

    def _written_plain(self, low: str) -> bool:
        if self.plain is None:
            self.plain = {m[0].lower() for m in _UNPOINTED.finditer(self.text)}
        return low in self.plain

    def _written_small(self, low: str) -> bool:
        if self.small is None:
            self.small = set(re.findall(r"\w+", self.text))
        return low in self.small

    def _by_document(self, low: str) -> bool | None:
        """Whether the document tells a word for an abbreviation or for none; None where it shows nothing or both."""
        own, plain = low in self.own, len(low) > 1 and self._written_plain(low)
        return None if own == plain else own

    def _abbreviation(self, word: str) -> bool:
        low = word.lower()
        told = self._by_document(low)
        if told is not None:
            return told
        return low in self.learned or low in LEADING or low in CLOSING or low == "г"

    def _back(self, start: int, end: int) -> str:
        """The text before ``end``: as much of it as words, initials and spaces there can need, all of it where that is more."""
        at = end - LOOK_BACK
        if at <= start or not re.search(r"\s[^\W\d_]{2,}\s|[^\w\s.][^.]*\s", self.text[at:end]):
            return self.text[start:end]
        return self.text[at:end]

    def _word_before(self, start: int, a: int) -> tuple[str, int]:
        """The word, with points between its letters, that ends at ``a``, and where it starts; '' if there is none."""
        text, j = self.text, a
        while j > start and (text[j - 1].isalpha() or text[j - 1] == "."):
            j -= 1
        if j > start and (text[j - 1].isalnum() or text[j - 1] == "_"):  # the run is the end of something with digits
            k = j
            while k < a and text[k] != ".":
                k += 1
            return "", a
        m = re.search(r"(?:(?<=[^\w.])|^)((?:[^\W\d_]\.)*[^\W\d_]+)$", text[j:a])
        return (m[1], j + m.start()) if m else ("", a)

    def _running(self, start: int, end: int) -> list[tuple[int, int]]:
        """Units of running text between two offsets."""
        text, out = self.text, []
        cuts = self._cuts(start, end)
        for a, b in zip([start, *cuts], [*cuts, end]):
            a, b = _strip(text, a, b)
            if a < b:
                out.append((a, b))
        return out

    def _cuts(self, start: int, end: int) -> list[int]:
        text, cuts = self.text, []
        inside = self._quotations(start, end)
        q = 0
        for m in re.finditer(rf"[{STOPS}{FULL}{OTHERS}]+[\"»“”」』）)'’\]]*|(?<=[฀-๿])\s+(?=[฀-๿])", text[start:end]):
            a, b = start + m.start(), start + m.end()
            if b >= end:
                break
            while q < len(inside) and inside[q][1] <= a:
                q += 1
            hit = m[0]
            if q < len(inside) and inside[q][0] < a < inside[q][1]:
                if b < inside[q][1]:
                    continue  # a point inside a quotation
            if hit.isspace():
                cuts.append(b)
                continue
            core = hit.rstrip("\"»“”」』）)'’]")
            if any(c in FULL for c in core):
                if core != hit and hit[-1] in "」』" and re.match(r"(?:と|って|という|とい|を|が|は|に|の|も)", text[b : b + 3]):
                    continue
                if b < end and text[b] in "，、；":
                    continue
                cuts.append(b)
            elif self._ends(a, b, core, hit, start, end):
                cuts.append(b)
        return cuts

    def _quotations(self, start: int, end: int) -> list[tuple[int, int]]:
        """Spans of the outermost quotations and brackets that are closed."""
        text, spans, stack = self.text, [], []
        for m in re.finditer(r"[«„“「『《〈(（\"»”」』》〉)）]", text[start:end]):
            c, at = m[0], start + m.start()
            if stack and c in PAIRS[stack[-1][0]] and not (c == "“" and stack[-1][0] == "“"):
                opened = stack.pop()
                if not stack:
                    spans.append((opened[1], at + 1))
            elif c in PAIRS:
                if c == '"' and at > start and not text[at - 1].isspace() and text[at - 1] not in "(（«":
                    continue
                stack.append((c, at))
        return spans

    def _ends(self, a: int, b: int, core: str, hit: str, start: int, end: int) -> bool:
        """Whether the terminator at text[a:b] ends a sentence; something follows it."""
        text = self.text
        if any(c in OTHERS for c in core):
            return text[b].isspace() or text[b].isalpha()
        if not text[b].isspace():  # a line break may have been lost: "дважды.Проект"
            if not (re.match(r"[«„“\"(]?[^\W\d_][^\W\d_]|[«„“\"(]?[^\W\d_]{1,3}\.\s|[^\W\d_]\s", text[b : b + 8]) and text[b : b + 2].strip("«„“\"(")[:1].isupper()):
                return False
            if core != "." or hit != core:
                return True
            j = a
            while j > start and text[j - 1].isalpha():
                j -= 1
            word = text[j:a]
            return bool(word) and (len(word) > 3 or not self._abbreviation(word)) and word[-1].islower() or a > start and text[a - 1].isdigit()
        k = b
        while k < end and not visible(text[k]):
            k += 1
        nxt = text[k]
        lead = k
        while lead < end and text[lead] in "«„“\"(「（'":
            lead += 1
        first = text[lead] if lead < end else nxt
        if first.islower() or nxt in "—–,;:)»”-|":
            return False
        if not (first.isalpha() or first.isdigit() or nxt in "«„“\"(№•" or unicodedata.category(first)[0] in "SL"):
            return False
        if core[-1] in "!?…" or core.startswith("..") or hit != core:
            return True
        if first.isalpha() and _script(first) == "DEVANAGARI":
            return False
        if a > start and "\u0900" <= text[a - 1] <= "\u097f":
            return False
        word, at = self._word_before(start, a)
        if not word:
            return True
        low, ahead = word.lower(), self._back(start, at)
        if len(word) == 1 and word.isupper() or re.fullmatch(r"(?:[A-ZА-ЯЁ]\.)+[A-ZА-ЯЁ]", word):
            if low == "u.s" or re.match(r"[^\W\d_]\.", text[lead : lead + 2]):
                return False
            return self._initials_end(ahead, first)
        if first.isalpha() and self._by_document(low) is False:
            return True  # the document writes it as a word
        if low == "г":
            return bool(re.search(r"\d\s*$", ahead))
        if low in ("п", "е", "к", "н", "д") and re.search(r"(?:^|\s)(?:т|и т|н)\.\s?$", ahead):
            return True  # т. п., т. д., т. е., т. к., н. э.
        if low in CLOSING and low not in LEADING:
            return True
        if low in ("м", "см", "п", "т", "кв") and re.search(r"\d\s*$", ahead):
            return True
        if low == "м" and re.search(r"кв\.\s?$", ahead):
            return True
        if self._abbreviation(word):
            follower = re.match(r"[^\W\d_]+", text[lead : lead + 40])
            return low not in LEADING and bool(follower) and self._written_small(follower[0].lower())
        return True

    def _initials_end(self, ahead: str, first: str) -> bool:
        """Whether initials end a sentence: they do behind their surname, not before it."""
        ahead = re.sub(r"(?:[A-ZА-ЯЁ]\.\s?)+$", "", ahead).rstrip()
        m = re.search(r"([^\W\d_]+(?:-[^\W\d_]+)?)$", ahead)
        if not m or not m[1][0].isupper() or len(m[1]) < 2 or m[1].isupper():
            return not m and first.isdigit()
        rest = ahead[: m.start()].rstrip()
        return bool(rest) and rest[-1] not in STOPS


def corpus_abbreviations(documents: DataFrame) -> DataFrame:
    """``(w)``: words that the whole corpus writes with a point before a small letter, and hardly without; one scan of all documents."""
    place = r"(?<![\p{L}\p{N}])\p{L}+\.(?=[  ]\p{Ll}|,)|(?<![\p{L}\p{N}.])\p{L}+(?=[  ]\p{L})"
    each = documents.select(F.explode(F.regexp_extract_all("text", F.lit(place), F.lit(0))).alias("x")).groupBy("x").agg(F.count("*").alias("k"))
    pointed = F.endswith("x", F.lit("."))
    counts = each.groupBy(F.lower(F.rtrim(F.col("x"), F.lit("."))).alias("w")).agg(F.sum(F.when(pointed, F.col("k")).otherwise(0)).alias("p"), F.sum(F.when(pointed, 0).otherwise(F.col("k"))).alias("n"))
    return counts.where("p >= 5 AND p >= 3 * n").select("w")


def _split(documents: DataFrame, kind: str, shape, max_broadcast: int) -> DataFrame:
    """``documents(doc_id, text)`` with ``units``, what ``shape`` makes of each text and its spans.

    The learned abbreviations are counted while they are collected; where they are more than ``max_broadcast``, each text gets those it contains
    by a join on its pointed words. A document has the same units either way.
    """
    learned = corpus_abbreviations(documents)
    few = [r[0] for r in learned.limit(max_broadcast + 1).collect()]
    if len(few) <= max_broadcast:
        known = frozenset(few)

        @F.pandas_udf(kind)
        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            splitter = Splitter(known)
            for texts in batches:
                yield pd.Series([shape(t, splitter.units(t)) if t else [] for t in texts.array], dtype="object")

        return documents.select("doc_id", split("text").alias("units"))

    @F.pandas_udf(kind)
    def split_own(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, words in batches:
            yield pd.Series([shape(t, Splitter(frozenset(() if w is None else w)).units(t)) if t else [] for t, w in zip(texts.array, words.array)], dtype="object")

    numbered = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    pointed = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)\."), F.lit(1)))
    own = numbered.select("h", F.explode(pointed).alias("w")).distinct().join(learned, "w").groupBy("h").agg(F.collect_set("w").alias("ws"))  # words of one text
    return numbered.join(own, "h", "left").select("doc_id", split_own("text", "ws").alias("units"))


def sentence_units(documents: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``(doc_id, sent_start, sent_end)``, one row per sentence unit; offsets count code points.

    NULL, empty and blank texts have no unit; repeated rows give repeated units.
    """
    spans = lambda text, units: [{"s": s, "e": e} for s, e in units]
    split = _split(documents.select("doc_id", "text"), "array<struct<s:int,e:int>>", spans, max_broadcast)
    return split.select("doc_id", F.explode("units").alias("u")).select("doc_id", F.col("u.s").alias("sent_start"), F.col("u.e").alias("sent_end"))


def sentence_texts(documents: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The units with their text and number within the document: ``(doc_id, sent_no, sent)``."""
    texts = lambda text, units: [text[s:e] for s, e in units]
    split = _split(documents.select("doc_id", "text"), "array<string>", texts, max_broadcast)
    return split.select("doc_id", F.posexplode("units").alias("sent_no", "sent"))
