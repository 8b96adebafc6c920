"""Free-entered values mapped to the entries of a reference list.

A BK-tree over the reference keys answers "every key within t edits" with triangle-inequality pruning, which
needs a true metric: the unrestricted Damerau-Levenshtein distance. The tree is asked once per distinct value, and the answers are
joined back. A reference list is counted first: up to ``max_broadcast`` entries it travels to the workers whole, beyond that
in shards of at most that size, one after the other; every shard answers with its nearest keys, and the shards' winners are merged. Both
ways give the same answers.

Thresholds: no edit in keys under 4 letters, one under 7, two from 7 up (``limit_for``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vedomost.session import cut_lineage, spread

MAX_BROADCAST = 20_000

# Cyrillic letters in the usual Latin transcription, and on the keys of a Latin keyboard.
TRANSLIT = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}
KEYBOARD = dict(zip("qwertyuiop[]asdfghjkl;'zxcvbnm,.`{}:\"<>~", "йцукенгшщзхъфывапролджэячсмитьбюёхъжэбюё"))
TYPE_WORDS = re.compile(r"(област[ьиью]+|обл|кра[йяею]|кр|округ[аеу]?|окр|район[аеу]?|р|н|он|рн|рон|муниципальн\w+|муниц|мун|м|о|мо|городск\w+|территори\w+|в|на|по|г|регион[аеу]?|код|составе|уточн|oblast|kray|okrug|rayon|munitsipaln\w+)")
GLUED = re.compile(r"(?<=\w{5})(область|области|район|района|районе|округ|округа|край|oblast|rayon|okrug|kray)$")
ENDING = re.compile(r"(?:ий|ая|ого|ой|ом|ую|ому|ою|ое|ия|ый|iy|aya|ogo|oy|om)$")


def damerau(a: str, b: str) -> int:
    """The unrestricted Damerau-Levenshtein distance, a metric (unlike its restricted form)."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


class BKTree:
    """Keys in a tree by distance; each key carries the ids that share it."""

    def __init__(self, distance: Callable[[str, str], int] = damerau):
        self.distance, self.root, self.ids = distance, None, {}

    def add(self, key: str, ident: int) -> None:
        if key in self.ids:
            if ident not in self.ids[key]:
                self.ids[key].append(ident)
            return
        self.ids[key] = [ident]
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while (d := self.distance(key, node[0])) in node[1]:
            node = node[1][d]
        node[1][d] = (key, {})

    def within(self, key: str, limit: int) -> list[tuple[int, str]]:
        """Every (distance, key) with distance <= limit, nearest first."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = self.distance(key, at)
            if d <= limit:
                found.append((d, at))
            todo += [child for e, child in children.items() if d - limit <= e <= d + limit]
        return sorted(found)


def fold_name(value: str) -> list[str]:
    """The ways a typed value may be meant: as it is, and as typed on the wrong keyboard layout."""
    import unicodedata

    text = unicodedata.normalize("NFKC", value).lower().replace("ё", "е")
    out = [text]
    if re.search("[a-z]", text) and not re.search("[а-я]", text):
        out.append("".join(KEYBOARD.get(c, c) for c in text))
    return out


def keys_of(text: str) -> list[str]:
    """The distinguishing words of a name, without type words and endings."""
    words = (GLUED.sub("", w) for w in re.findall(r"\w+", text))
    words = [w for w in words if w and not TYPE_WORDS.fullmatch(w) and not w.isdigit()]
    return [ENDING.sub("", w) for w in words]


def reference_key(name: str) -> str:
    return " ".join(keys_of(fold_name(name)[0]))


def forms(key: str) -> list[str]:
    return list(dict.fromkeys([key, "".join(TRANSLIT.get(c, c) for c in key)]))


def limit_for(key: str) -> int:
    """Edits allowed in a key: none under 4 letters, one under 7, else two."""
    return 0 if len(key) < 4 else 1 if len(key) < 7 else 2


class Gazetteer:
    """Reference entries ``(id, name, code)`` behind a BK-tree of their keys."""

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        self.tree = BKTree()
        self.codes: dict[str, list[int]] = {}
        for ident, name, code in sorted(entries, key=lambda e: e[0]):
            if name and (key := reference_key(name)):
                for form in forms(key):
                    self.tree.add(form, ident)
            if code:
                self.codes.setdefault(code, []).append(ident)

    def nearest(self, value: str) -> tuple[int, list[list[int]]]:
        """(distance, the ids of each nearest key); a code standing alone is nearer than any key (-1), 99 means nothing near."""
        best: tuple[int, dict[str, list[int]]] = (99, {})
        for text in fold_name(value):
            digits = re.findall(r"\d+", text)
            if len(digits) == 1 and digits[0] in self.codes and all(TYPE_WORDS.fullmatch(w) for w in re.findall(r"[^\W\d]+", text)):
                return -1, [self.codes[digits[0]]]
            words = keys_of(text)
            for key in dict.fromkeys([*words, " ".join(words)]):
                for d, near in self.tree.within(key, min(limit_for(key), best[0])):
                    if d < best[0]:
                        best = d, {}
                    if d == best[0]:
                        best[1][near] = sorted(self.tree.ids[near])
        return best[0], list(best[1].values())


def map_values(values: DataFrame, reference: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``(value, ids)``: for each row of ``values(value)``, which are distinct, the entries of the nearest key.

    ``reference(id BIGINT, name, code)``. ids has several entries where entries share a name; it is empty where nothing is near or
    keys of different entries are equally near. Values in which only one shard finds the nearest key get that key's entries, so the
    number of shards changes nothing as long as equal names lie in one shard, which the hash of the key sees to.
    """
    size = reference.where("name IS NOT NULL").count()
    shards = max(1, -(-size // max_broadcast))
    # a hash spreads names unevenly: shards half as large as allowed, and each is counted before it travels
    shards = shards if shards == 1 else 2 * shards
    named = reference.where("name IS NOT NULL").withColumn("_s", F.pmod(F.xxhash64(_same_key("name")), F.lit(shards)))
    won = None
    for shard in range(shards):
        entries = [tuple(r) for r in named.where(F.col("_s") == shard).select("id", "name", "code").limit(max_broadcast + 1).collect()]
        if len(entries) > max_broadcast:
            raise ValueError(f"more than {max_broadcast} entries share the hash of their name: raise max_broadcast")
        found = values.select("value", _nearest(entries)("value").alias("n")).select("value", "n.*")
        won = found if won is None else won.unionByName(found)
    if shards == 1:
        return won.select("value", _only("sets").alias("ids"))
    best = won.groupBy("value").agg(F.min("distance").alias("d"), F.collect_list(F.struct("distance", "sets")).alias("all"))  # one entry per shard
    sets = F.array_distinct(F.flatten(F.transform(F.filter("all", lambda x: x.distance == F.col("d")), lambda x: x.sets)))
    return best.withColumn("sets", sets).select("value", _only("sets").alias("ids"))


def _only(sets: str):
    return F.when(F.size(sets) == 1, F.col(sets)[0]).otherwise(F.array().cast("array<bigint>"))


def _same_key(name: str):
    @F.pandas_udf("string")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([reference_key(x) for x in b.array], dtype="object")

    return key(name)


def _nearest(entries: list[tuple[int, str, str | None]]):
    @F.pandas_udf("struct<distance:int,sets:array<array<bigint>>>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gazetteer = Gazetteer(entries)
        for b in batches:
            found = [gazetteer.nearest(x) for x in b.array]
            yield pd.DataFrame({"distance": pd.Series([d for d, _ in found], dtype="int32"), "sets": pd.Series([list(dict.fromkeys(map(tuple, s))) for _, s in found], dtype="object")})

    return nearest


def map_places(records: DataFrame, district_ref: DataFrame, region_ref: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``(rec_id, field, value, ref_id)`` for each non-empty district and region of the records that is not
    literally the name of exactly one entry.

    ref_id is -1 for a value that means no entry (fillers, unknown names, values equally near to two names, a
    name of several regions where neither the record's region nor the value itself tells which). NULL and blank values give no row,
    repeated records one row; empty references give -1 throughout.
    """
    visible = lambda c: F.coalesce(F.col(c).rlike(r"(?U)[^\s\u200b\u2060\ufeff]"), F.lit(False))
    asked = records.select("rec_id", "district", "region").where(visible("district") | visible("region"))
    typed = asked.select(F.explode(F.array(F.struct(F.lit("d").alias("f"), F.col("district").alias("value")), F.struct(F.lit("r").alias("f"), F.col("region").alias("value")))).alias("x"))
    typed = typed.select("x.*").where(visible("value")).groupBy("value").agg(F.bool_or(F.col("f") == "d").alias("is_district"))
    typed = cut_lineage(spread(typed, "value"))  # the distinct values; both searches start from them
    districts = district_ref.select(F.col("district_id").cast("long").alias("id"), F.col("district_name").alias("name"), F.lit(None).cast("string").alias("code"))
    regions = region_ref.select(F.col("region_id").cast("long").alias("id"), F.col("region_name").alias("name"), F.col("region_code").alias("code"))
    once = lambda ref: ref.where("name IS NOT NULL").groupBy(F.col("name").alias("value")).agg((F.count("*") == 1).alias("literal"))
    by_region = map_values(typed.select("value"), regions, max_broadcast)
    by_region = by_region.select("value", F.when(F.size("ids") == 1, F.col("ids")[0]).otherwise(-1).alias("region_id")).join(once(regions), "value", "left")
    by_region = cut_lineage(by_region.withColumn("literal", F.coalesce("literal", F.lit(False))))
    home = district_ref.select(F.col("district_id").cast("long").alias("id"), F.col("region_id").cast("long").alias("home")).where("id IS NOT NULL").distinct()
    by_district = map_values(typed.where("is_district").select("value"), districts, max_broadcast)
    candidates = by_district.select("value", F.explode_outer("ids").alias("id")).join(home, "id", "left").groupBy("value").agg(F.collect_set(F.struct("id", "home")).alias("entries"))  # entries of one name
    candidates = candidates.join(by_region.select("value", F.col("region_id").alias("own")), "value", "left").join(once(districts), "value", "left")
    told = candidates.select(F.col("value").alias("district"), "entries", "own", F.coalesce("literal", F.lit(False)).alias("district_literal"))
    j = asked.join(told, "district", "left").join(by_region.withColumnsRenamed({"value": "region", "literal": "region_literal"}), "region", "left")
    within = lambda region: F.filter("entries", lambda e: e.home == F.col(region))
    pick = lambda found: F.when(F.size(found) == 1, found[0]["id"])
    several = F.size("entries") > 1
    chosen = F.when(several, F.when(F.size(within("region_id")) > 0, pick(within("region_id"))).otherwise(pick(within("own")))).otherwise(F.col("entries")[0]["id"])
    cells = F.array(
        F.when(F.col("entries").isNotNull() & ~F.col("district_literal"), F.struct(F.lit("district").alias("field"), F.col("district").alias("value"), F.coalesce(chosen, F.lit(-1)).cast("long").alias("ref_id"))),
        F.when(F.col("region_id").isNotNull() & ~F.col("region_literal"), F.struct(F.lit("region").alias("field"), F.col("region").alias("value"), F.col("region_id").alias("ref_id"))),
    )
    return j.select("rec_id", F.inline(F.filter(cells, lambda x: x.isNotNull()))).distinct()
