"""Variant spellings of organisations and persons, linked.

A spelling is read into its class (organisation, administration, person), what keeps entities of one
class apart (number, kind of activity or settlement, given names) and its core words. Core words are put in one order and
one alphabet, so legal forms, quotes, word order, glued or split words, abbreviations and transcription fall away. What
is left are typing errors: spellings are blocked by the phonetic code of their sorted core words and the codes with one letter
left out, so blocks hold near-equal codes only; pairs within a block are compared by Jaro-Winkler and edit distance, given names
by a nickname table and initials; accepted pairs are clustered by connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vedomost.llm.canonmap import TRANSLIT, damerau
from vedomost.session import cut_lineage

# Fixed values, in transcription: legal forms written out.
LEGAL = [
    ("pao", r"publichnoe aktsionernoe obshchestvo|p\.? ?a\.? ?o"),
    ("zao", r"zakrytoe aktsionernoe obshchestvo|zao"),
    ("ooo", r"obshchestvo s ogranichennoy otvetstvennostyu|o\.? ?o\.? ?o"),
    ("ao", r"aktsionernoe obshchestvo|oao|a\.? ?o"),
    ("ip", r"(?:individualn\w+ |ind\.? ?)?predprinimatel|i\.? ?p"),
]
# Kinds of activity by their words, by their letters and as the end of a word.
ACTIVITY_WORDS = {"uds": ("upravlenie", "dorozhnogo", "stroitelstva"), "ums": ("upravlenie", "mekhanizatsii", "stroitelstva"), "pos": ("proizvodstvennoe", "obedinenie", "svyazi"), "pbr": ("predpriyatie", "burovykh", "rabot"), "dks": ("direktsiya", "kapitalnogo", "stroitelstva"), "pib": ("proektno", "izyskatelskoe", "byuro")}
TELLING = {"dorozhnogo": "uds", "mekhanizatsii": "ums", "svyazi": "pos", "obedinenie": "pos", "proizvodstvennoe": "pos", "burovykh": "pbr", "predpriyatie": "pbr", "rabot": "pbr", "direktsiya": "dks", "kapitalnogo": "dks", "byuro": "pib", "izyskatelskoe": "pib", "proektno": "pib"}
SUFFIXES = ("dorstroy", "geoservis", "neftegaz", "burenie", "montazh", "proekt", "energo", "stroy")
SETTLEMENT = {"gp": r"g/p|gp|gorodsk\w* pos\w*|gor\.? ?pos\w*", "sp": r"s/p|sp|selsk\w* pos\w*|sel\.? ?pos\w*", "mo": r"mo|m/o|munitsipaln\w* obr\w*|mun\.? ?obr\w*"}
OFFICE = r"(?:mestnaya )?(?:administratsiya|administratsii|admin-tsiya|administr|admin|adm)"
# Usual short forms of given names, in transcription.
NICKNAMES = {"dima": "dmitriy", "mitya": "dmitriy", "sasha": "aleksandr", "shura": "aleksandr", "lyosha": "aleksey", "lesha": "aleksey", "misha": "mikhail", "kolya": "nikolay", "vanya": "ivan", "petya": "petr", "seryozha": "sergey", "serezha": "sergey", "zhenya": "evgeniy", "borya": "boris", "pasha": "pavel", "tima": "timofey", "fedya": "fedor", "edik": "eduard", "roma": "roman", "vadik": "vadim", "yasha": "yakov", "gosha": "georgiy", "grisha": "grigoriy", "vova": "vladimir", "volodya": "vladimir", "tolya": "anatoliy", "kostya": "konstantin", "egorka": "egor", "lyova": "lev", "slava": "vyacheslav", "yura": "yuriy", "valera": "valeriy", "vitya": "viktor", "andryusha": "andrey", "artyom": "artem", "stepa": "stepan", "lenya": "leonid", "kirya": "kirill", "kiryusha": "kirill", "leva": "lev", "artyoma": "artem", "denya": "denis", "zakharka": "zakhar", "olezhek": "oleg", "garik": "igor", "maks": "maksim"}
LEAST_SIMILARITY = 0.85


def transcribe(name: str) -> str:
    text = unicodedata.normalize("NFKC", name.replace("№", " ")).lower().replace("ё", "е")
    return "".join(TRANSLIT.get(c, c) for c in text)


def letters(key: str) -> str:
    """One sign per letter: transcribed pairs such as kh become one, so that one wrong letter is one edit."""
    for pair, sign in (("shch", "q"), ("sh", "w"), ("ch", "c"), ("zh", "j"), ("kh", "x")):
        key = key.replace(pair, sign)
    return key


def phonetic(word: str) -> str:
    """A code that is the same for letters that are often confused: vowels and voiced pairs.

    Doubled letters stay: joined to one, a vowel left out between them would cost two letters.
    """
    return word.translate(str.maketrans("oeiyuzdbgvjq", "aaaaastpkfww"))


def _near(word: str, vocabulary: tuple[str, ...]) -> str | None:
    """The vocabulary's word that ``word`` is, or is one edit from."""
    if word in vocabulary:
        return word
    return next((v for v in vocabulary if len(v) >= 7 and abs(len(v) - len(word)) <= 1 and damerau(v, word) <= 1), None)


_VOCABULARY = tuple(dict.fromkeys([*TELLING, "upravlenie", "stroitelstva"]))


def parse_party(name: str) -> tuple[str, str, str, str, str, str, str]:
    """(class, kind, number, legal form, key, given, patronymic) of a spelling; the key holds its sorted core words."""
    text = re.sub(r"[«»\"“”„‟'‘’`(),;]", " ", transcribe(name))
    text = re.sub(r"\s+", " ", text).strip(" .")
    legal = ""
    for form, pattern in LEGAL:
        if re.search(rf"(?<![\w/])(?:{pattern})(?![\w/])", text):
            text, legal = re.sub(rf"(?<![\w/])(?:{pattern})(?![\w/])", " ", text, count=1), legal or form
            break
    if legal == "ip":
        return _person(text)
    if re.search(rf"(?<!\w){OFFICE}(?!\w)", text) or re.search(r"(?<!\w)(?:rayon\w*|r-na|r-n)(?!\w)", text):
        return _administration(text)
    return _organisation(text, legal)


def _initial(word: str) -> bool:
    return len(word) == 1 or word in ("ya", "yu", "zh", "kh", "ts", "ch", "sh", "shch")


def _person(text: str) -> tuple[str, str, str, str, str, str, str]:
    words = re.findall(r"[a-z]+", text)
    extra = sorted(w for w in words if w in ("ml", "st"))
    words = [w for w in words if w not in extra]
    long_ = [w for w in words if not _initial(w)]
    patronymic = next((w for w in long_ if re.search(r"(?:[oe]vich|ich|[oe]vna|ichna)$", w)), "")
    rest = [w for w in long_ if w != patronymic]
    initials = [w for w in words if _initial(w)]
    if len(rest) > 1:
        surname = next((w for w in rest if re.search(r"(?:ov|ev|in|yn|ova|eva|ina|skiy)$", w) and w not in NICKNAMES), max(rest, key=len))
        given = next(w for w in rest if w != surname) if any(w != surname for w in rest) else ""
    else:
        surname, given = (rest[0] if rest else ""), ""
    given = NICKNAMES.get(given, given) or (initials[0] if initials else "")
    patronymic = patronymic or (initials[1] if len(initials) > 1 else initials[0] if initials and len(given) > 1 else "")
    return "person", "", " ".join(extra), "ip", surname, given, patronymic


def _stem(word: str) -> str:
    """An adjective up to its -sk-."""
    return re.sub(r"(?<=[a-z]{3}sk)(?:oe|aya|ogo|iy|oy|om|oi|ie|i)$", "", word)


def _administration(text: str) -> tuple[str, str, str, str, str, str, str]:
    text = re.sub(rf"(?<!\w){OFFICE}(?!\w)\.?", " ", text)
    text = re.sub(r"(?<!\w)(?:munitsipaln\w*|mun\.?) (?=r)", " ", text)
    kind = ""
    for k, pattern in SETTLEMENT.items():
        if re.search(rf"(?<![\w/])(?:{pattern})(?![\w/])", text):
            text, kind = re.sub(rf"(?<![\w/])(?:{pattern})(?![\w/])\.?", " ", text), k
            break
    text = re.sub(r"(?<!\w)(?:rayon\w*|r-na|r-n|r-ne)(?!\w)\.?", " ", text)
    words = sorted(_stem(w) for w in re.findall(r"[a-z]{3,}", text))
    return "administration", kind, " ".join(re.findall(r"\d+", text)), "", " ".join(words), "", ""


def _organisation(text: str, legal: str) -> tuple[str, str, str, str, str, str, str]:
    number = " ".join(str(int(x)) for x in re.findall(r"(?<![a-z])\d+(?![a-z])", text))
    words: list[str] = []
    kind = ""
    for m in re.finditer(r"([a-z]+)(\.?)", text):
        word, dotted = m[1], bool(m[2])
        if word in ACTIVITY_WORDS:
            kind = kind or word
        elif known := _near(word, _VOCABULARY) or (dotted and len(word) >= 2 and next((v for v in _VOCABULARY if v.startswith(word) and not word.endswith("sk")), None)):
            kind = kind or TELLING.get(known, "")
            if dotted and known != word:  # a short form may stand for several words
                kinds = {k for k, vs in ACTIVITY_WORDS.items() if all(any(v.startswith(w) for v in vs) for w in _dotted(text))}
                kind = next(iter(kinds)) if len(kinds) == 1 else kind
        elif word in SUFFIXES and words:
            words[-1] += word
        else:
            words.append(word)
    words = [_stem(w) for w in words]
    if kind:
        return "organisation", kind, number, legal, " ".join(sorted(words)), "", ""
    ends = [next((s for s in SUFFIXES if w.endswith(s) and len(w) > len(s) + 2), "") for w in words]
    kind = next((e for e in ends if e), "")
    order = sorted(range(len(words)), key=lambda i: (bool(ends[i]), words[i]))
    return "organisation", kind, number, legal, "".join(words[i] for i in order), "", ""


def _dotted(text: str) -> list[str]:
    return [w for w in re.findall(r"([a-z]{2,})\.", text) if not w.endswith("sk")]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    moved = sum(x != y for x, y in zip(hits, other)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return jaro + min(prefix, 4) * 0.1 * (1 - jaro)


def deletes(word: str) -> list[str]:
    """The word and the word with each one letter left out."""
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]))


def compatible_names(a: tuple[str, str], b: tuple[str, str]) -> bool:
    """Whether (given, patronymic) pairs may belong to one person: equal, nearly equal, or initials of each other."""
    for x, y in zip(a, b):
        if x and y and x != y:
            short = _initial(x) or _initial(y)
            if short and not (x.startswith(y) or y.startswith(x)) or not short and damerau(x, y) > 1:
                return False
    return True


def same_party(cls: str, kind_a: str, kind_b: str, a: str, b: str, names_a: tuple[str, str], names_b: tuple[str, str]) -> bool:
    """Whether two keys of one class and number are spellings of the same entity."""
    if kind_a and kind_b and kind_a != kind_b or (cls == "administration" and kind_a != kind_b):
        return False
    if cls == "person" and not compatible_names(names_a, names_b):
        return False
    return a == b or (damerau(a, b) <= (1 if len(a) < 24 else 2) and jaro_winkler(a, b) >= LEAST_SIMILARITY)


_PARSED = "cls string, kind string, number string, legal string, key string, given string, patronymic string, code string"


def parsed_names(names: DataFrame) -> DataFrame:
    """``names(name_id, name)`` with the parts of each spelling."""

    @F.pandas_udf(_PARSED)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*r[:4], letters(r[4]), *r[5:]) for r in map(parse_party, batch.array)]
            yield pd.DataFrame([(*r, phonetic(r[4].replace(" ", ""))) for r in rows], columns=["cls", "kind", "number", "legal", "key", "given", "patronymic", "code"])

    return names.where("name IS NOT NULL").select("name_id", parse("name").alias("p")).select("name_id", "p.*")


def link_keys(keys: DataFrame) -> DataFrame:
    """Accepted pairs ``(a, b)`` of distinct keys ``(rep, cls, kind, number, key, given, patronymic, code)``.

    Blocks are the codes with at most one letter left out. Organisations and administrations of a block differ in that letter only.
    Persons of one surname are as many as it has bearers, so their blocks are the code with the initial of the given name, and with that
    of the patronymic, in which a wrong first letter of a given name is met; those without a given name, whom any bearer may be, are
    met by all of their surname from one side only.
    """

    @F.pandas_udf("array<string>")
    def blocks(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cls, code, given, patronymic in batches:
            out = []
            for k, c, g, p in zip(cls.array, code.array, given.array, patronymic.array):
                ends = [f"|g{g[:1]}" if g else "", f"|p{p[:1]}" if g and p else ""] if k == "person" else ["|"]
                out.append([d + e for d in deletes(c) for e in ends if e])
            yield pd.Series(out, dtype="object")

    @F.pandas_udf("array<string>")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([deletes(c) for c in batch.array], dtype="object")

    @F.pandas_udf("boolean")
    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for d in batches:
            yield pd.Series([same_party(*x[:5], x[5:7], x[7:9]) for x in zip(*(d[c].array for c in d.columns))], dtype="bool")

    fields = ["rep", "cls", "kind", "number", "key", "given", "patronymic"]
    coded = keys.where("code <> ''")
    blocked = coded.select(*fields, F.explode(blocks("cls", "code", "given", "patronymic")).alias("block")).withColumn("block", F.xxhash64("cls", "number", "block"))
    people = coded.where("cls = 'person'").select(*fields, F.explode(codes("code")).alias("block")).withColumn("block", F.xxhash64("cls", "number", "block"))
    other = lambda df: df.select(F.col("block"), *[F.col(c).alias(f"{c}_b") for c in fields])
    met = blocked.join(other(blocked), "block").where("rep < rep_b AND cls = cls_b AND number = number_b")
    nameless = people.where("given = ''").join(other(people), "block").where("rep <> rep_b AND number = number_b AND (given_b <> '' OR rep < rep_b)")
    pairs = met.unionByName(nameless).where("cls = 'organisation' OR kind = kind_b").drop("block", "cls_b", "number", "number_b").distinct()
    accepted = pairs.where(same(F.struct("cls", "kind", "kind_b", "key", "key_b", "given", "patronymic", "given_b", "patronymic_b")))
    return accepted.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct()


def sure_initials(keys: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` without those of initials that fit two different persons of the surname.

    The first and the last name in alphabetical order are looked at first: where they differ the persons do. Only where these two agree, as spellings
    of one name do, the names between them are listed and compared.
    """
    short = (F.col("cls") == "person") & ((F.length("given") <= 2) | (F.length("patronymic") <= 2))
    side = keys.select(F.col("rep"), short.alias("short"), "given", "patronymic")
    both = links.union(links.select("b", "a")).toDF("from", "to")
    seen = both.join(side.where("short").select(F.col("rep").alias("from")), "from").join(side.where("NOT short").select(F.col("rep").alias("to"), F.concat_ws("|", "given", "patronymic").alias("name")), "to")

    @F.pandas_udf("boolean")
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([all(compatible_names(tuple(x.split("|")), tuple(y.split("|"))) for i, x in enumerate(v) for y in list(v)[:i]) for v in batch.array], dtype="bool")

    ends = cut_lineage(seen.groupBy("from").agg(F.min("name").alias("least"), F.max("name").alias("most")).where("least <> most").withColumn("alike", one(F.array("least", "most"))))
    listed = seen.join(ends.where("alike").select("from"), "from", "left_semi").groupBy("from").agg(F.collect_set("name").alias("names"))
    unsure = ends.where("NOT alike").select("from").unionByName(listed.where(F.size("names") > 2).where(~one("names")).select("from"))
    return links.join(unsure.select(F.col("from").alias("a")), "a", "left_anti").join(unsure.select(F.col("from").alias("b")), "b", "left_anti").select("a", "b")


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``; the component is its least id.

    Large-star and small-star rounds alternate until nothing changes, however long the chains; each round is cut to the
    shared checkpoint folder, so a lost executor costs one round, and told from the last one by one count. Both stars group by node
    with ``min`` first, so a node with very many links is no collected list.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    now = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select("v", "m").toDF("u", "v").union(down.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        before, now = now, state(edges)
        if before == now:
            return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")


def cluster_parties(names: DataFrame) -> DataFrame:
    """``(name_id, cluster)``: spellings of one entity share the cluster, the least name_id of its representatives.

    NULL names have no row; a name without any core word is alone unless spelled alike. Repeated rows stay. Every
    spelling has a cluster, its own if nothing is linked to it.
    """
    parsed = cut_lineage(parsed_names(names))
    identity = ["cls", "kind", "number", "key", "given", "patronymic"]
    keys = cut_lineage(parsed.groupBy(*identity, "code").agg(F.min("name_id").alias("rep")))
    components = connected_components(sure_initials(keys, link_keys(keys)))
    rep = parsed.join(keys.drop("code"), identity).select("name_id", "rep")
    return rep.join(components, rep["rep"] == components["id"], "left").select("name_id", F.coalesce("component", "rep").alias("cluster"))


def link_counts(clusters: DataFrame) -> DataFrame:
    """``(name_id, cluster, n_links)``: each spelling with how many others it is linked to, for clusters of any size."""
    ids = clusters.distinct()
    sizes = ids.groupBy("cluster").agg((F.count("*") - 1).alias("n_links"))
    return ids.join(sizes, "cluster").select("name_id", "cluster", "n_links")


def linked_pairs(clusters: DataFrame) -> DataFrame:
    """All pairs ``(name_id_a, name_id_b)`` of different ids in one cluster, a < b."""
    ids = clusters.distinct()
    a, b = ids.select(F.col("name_id").alias("name_id_a"), "cluster"), ids.select(F.col("name_id").alias("name_id_b"), "cluster")
    return a.join(b, "cluster").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
