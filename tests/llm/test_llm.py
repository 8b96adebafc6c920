import random

import numpy as np
import pytest

from vedomost.llm import canonmap, mixture, ocrnoise, party, sentences, survivor, tokens
from vedomost.llm.lookalike import lookalike_values, plain_text


def test_plain_text():
    assert plain_text("ＲU­-4Ο433214-12-2Ο26", "number") == "RU-40433214-12-2026"
    assert plain_text("Шкoла № 5 IР-камера") == "Школа № 5 IP-камера"
    assert plain_text("стойка") == "стойка"


def test_lookalike_values(spark):
    rows = [("t", 1, "object", "склад с PE 100"), ("t", 2, "object", "склад c забором"), ("t", 3, "object", "Шкoла"), ("t", 4, "object", None), ("t", 5, "object", ""), ("t", 6, "object", "склад с навесом"), ("t", 7, "object", "а б"), ("t", 6, "object", "склад с навесом")]
    got = {r.row_id for r in lookalike_values(spark.createDataFrame(rows, "tab string, row_id long, scope string, value string")).collect()}
    assert got == {2, 3, 7}


def test_survivors(spark):
    import datetime

    t = lambda d: datetime.datetime(2024, 1, d)
    schema = "number string, rec_id long, end_date string, changed string, issuer string, builder string, field_quality map<string,struct<status:string,reason:string,confidence:double>>, received_at timestamp"
    rows = [("n", 1, "01.01.2025", None, "Орган района", "ООО «Ромашка»", None, t(1)), ("n", 2, "31.02.2026", "x", "н/д", "ООО «Рома", None, t(2)), ("n", 3, "2026-05-05", None, "Орган рай…", "ООО Б", {"builder": ("review", "r", 1.0)}, t(3)), ("m", 4, "01.01.2025", None, None, None, None, t(1))]
    df = spark.createDataFrame(rows, schema)
    got = {(r.number, r.field): r.rec_id for r in survivor.survivor_cells(survivor.permit_survivors(df)).collect()}
    assert got == {("n", "end_date"): 3, ("n", "issuer"): 1, ("n", "builder"): 1}
    assert survivor.permit_survivors(df.where("false")).count() == 0


def test_votes_decide_not_only_the_latest(spark):
    import datetime

    rows = [("n", i, v, datetime.datetime(2024, 1, i)) for i, v in enumerate(["ООО Альфа", "ООО Альфа", "ООО Альфа", "ООО Бета"], 1)]
    df = spark.createDataFrame(rows, "number string, rec_id long, builder string, received_at timestamp")
    rule = {"builder": survivor.FieldRule("name", survivor.F.lit(1.0))}
    won = lambda days: survivor.resolve_fields(df, "number", "rec_id", "received_at", rule, days).first().builder
    assert won(180).row_id == 3 and won(0.01).row_id == 4 and won(survivor.LATEST_WINS).row_id == 4
    at = [(datetime.datetime(2024, 1, i) - datetime.datetime(1970, 1, 1)).days for i in (1, 2, 3)]
    assert abs(won(180).votes - np.log2(sum(2 ** (d / 180) for d in at))) < 1e-6
    with pytest.raises(ValueError):
        won(0)


def test_votes_are_summed_over_buckets():
    import math

    assert survivor.SPAN == 512 and math.isfinite(2.0**survivor.SPAN * 1e9)


def test_script_sets_decide():
    from vedomost.llm.lookalike import resolve_token

    assert resolve_token("Школа")[0] >= {"Cyrillic"} and not resolve_token("Шкoла")[0] and resolve_token("Шкoла")[1] >= {"Cyrillic"} and "Latin" not in resolve_token("Шкoла")[1]
    assert {"Cyrillic", "Latin"} <= resolve_token("сор")[1] and resolve_token("Αθήνα")[0] == {"Greek"} and "Cyrillic" not in resolve_token("Αθήνα")[1]
    assert not resolve_token("Աbc")[0] and plain_text("հouse") == "house"


def test_other_scripts_are_no_case_but_mixtures_are(spark):
    rows = [("t", 1, "object", "Αθήνα"), ("t", 2, "object", "հouse"), ("t", 3, "object", "дом 2О15"), ("t", 4, "object", "家屋"), ("t", 5, "object", "домж b")]
    got = {r.row_id: r.fixes for r in lookalike_values(spark.createDataFrame(rows, "tab string, row_id long, scope string, value string")).collect()}
    assert got.keys() == {2, 3} and got[2] == {"հouse": "Latin"}


def test_bk_tree_finds_what_brute_force_finds():
    rng = random.Random(3)
    keys = list({"".join(rng.choices("абвг", k=rng.randint(2, 7))) for _ in range(150)})
    tree = canonmap.BKTree()
    for i, k in enumerate(keys):
        tree.add(k, i)
    for ask in rng.sample(keys, 20) + ["аааа", ""]:
        assert [x for x in tree.within(ask, 2)] == sorted((d, k) for k in keys if (d := canonmap.damerau(ask, k)) <= 2)
    assert canonmap.damerau("ca", "abc") == 2


def test_places(spark):
    d = spark.createDataFrame([(1, "Жигаловский район", 1), (2, "Горский район", 1), (3, "Горский район", 2)], "district_id long, district_name string, region_id long")
    r = spark.createDataFrame([(1, "Омская область", "100"), (2, "Тверский край", "200")], "region_id long, region_name string, region_code string")
    rows = [(1, "Жигаловский район", "Омская область"), (2, "Горский район", "код 200"), (3, ";buфkjdcrbq", "обл. Омская"), (4, "Жгаловский р-н", None), (5, " ", "Марс"), (6, "Zhigalovskiy rayon", "Jvcrfz j,kfcnm"), (1, "Жигаловский район", "Омская область")]
    got = {(x.rec_id, x.field): x.ref_id for x in canonmap.map_places(spark.createDataFrame(rows, "rec_id long, district string, region string"), d, r).collect()}
    assert got[2, "district"] == 3 and got[2, "region"] == 2 and got[4, "district"] == 1 and got[5, "region"] == -1 and got[6, "district"] == 1 and got[6, "region"] == 1
    assert (1, "district") not in got and (5, "district") not in got


def test_sharded_places_equal_broadcast_ones(spark):
    d = spark.createDataFrame([(i, f"{n} район", 1 + i % 2) for i, n in enumerate("Жигаловский Горский Горский Омский Тверской Лимский Лимбский Камский".split(), 1)], "district_id long, district_name string, region_id long")
    r = spark.createDataFrame([(1, "Омская область", "100"), (2, "Тверский край", "200"), (3, "Камская область", "300")], "region_id long, region_name string, region_code string")
    typed = ["Жигаловскй район", "Горский", "Лимский р-н", "Лимсбкий", "Камский", "Марс", "код 200", "камская обл", "", None]
    rows = spark.createDataFrame([(i, a, typed[(i * 3) % len(typed)]) for i, a in enumerate(typed)], "rec_id long, district string, region string")
    want = {tuple(x) for x in canonmap.map_places(rows, d, r).collect()}
    assert want and want == {tuple(x) for x in canonmap.map_places(rows, d, r, max_broadcast=3).collect()}
    assert canonmap.map_places(rows, d.where("false"), r.where("false")).where("ref_id <> -1").count() == 0


def test_party_parts():
    p = party.parse_party
    same = ["ООО «Чикнавтик Мирбавпроект»", "Мирбавпроект Чикнавтик (ООО)", "ООО «Чикнавтик Мирбав-проект»", "Общество с ограниченной ответственностью ЧикнавтикМирбавпроект", "OOO Chiknavtik Mirbavproekt"]
    assert len({(p(x)[0], p(x)[1], p(x)[4]) for x in same}) == 1
    assert p("АО «Х-ское УДС Заскар № 2»")[1:3] == ("uds", "2")
    assert p("Администрация Лимгамского района, Вуркорримского г/п")[4] == p("Вуркорримское городское поселение Лимгамского мун. р-на (администрация)")[4]
    assert party.compatible_names(("t", "m"), ("timofey", "makarovich")) and not party.compatible_names(("oleg", ""), ("timofey", ""))
    assert p("ИП Буздулсакин Тима Петрович")[5] == "timofey"


def test_party_clusters(spark):
    names = ["ИП Лимов Олег Макарович", "ИП Лимов О. М.", "ИП Лимов Тимофей Макарович", "ООО «Чикнавтик Мирбавпроект»", "ООО Чикнвтик Мирбавпроект", "ООО «Чикнавтик Мирбавстрой»", None]
    df = spark.createDataFrame(list(enumerate(names)), "name_id long, name string")
    assert {(r.name_id_a, r.name_id_b) for r in party.linked_pairs(party.cluster_parties(df)).collect()} == {(0, 1), (3, 4)}


def test_scan_noise_parts():
    assert ocrnoise.misreading_cost("райоп", "район") == 1.0 and ocrnoise.misreading_cost("почвен`ый", "почвенный") == 1.5
    assert ocrnoise.misreading_cost("дом", "кот") is None and ocrnoise.skeleton("райоп") == ocrnoise.skeleton("район")


@pytest.mark.parametrize("block", [8, 16, 50, 1 << 16])
def test_streamed_ids_equal_whole_ids(block):
    import tiktoken

    ranks = tokens.merge_ranks("byte_bpe_50k")
    want = tiktoken.Encoding("own", pat_str=tokens.splitting_pattern().pattern, mergeable_ranks=ranks, special_tokens={})
    e, d = tokens.StreamingEncoder(block=block), tokens.StreamingDecoder()
    for t in ("", "we'll it's", "а" * 900, " " * 300 + "x", "สวัสดี" * 60, "\n\n  y", "<|endoftext|>", "1234567890" * 40, "é !?" * 30):
        ids = e.encode(t)
        assert ids == want.encode_ordinary(t) and d.decode(ids) == t


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    pi, size = np.full(400, 0.3), rng.integers(1, 900, 400).astype(float)
    out = mixture.flight(pi, np.column_stack([np.ones(400), size]), rng)
    assert ((out > 0) & (out < 1)).sum() <= 3 and abs(out.sum() - 120) < 1e-6 and abs((out * size).sum() - 0.3 * size.sum()) < 1e-3


def test_sentences():
    units = lambda t: [t[a:b] for a, b in sentences.Splitter().units(t)]
    assert units("Работы завершены в 2012 г. Объект: ул. Мира, д. 5. Подписал Салчузов П. К. Геодезия готова.") == ["Работы завершены в 2012 г.", "Объект: ул. Мира, д. 5.", "Подписал Салчузов П. К.", "Геодезия готова."]
    assert units("«Готово. Нет», — сказал А. Б. Петров. Да!") == ["«Готово. Нет», — сказал А. Б. Петров.", "Да!"]
    assert units("Приложение № 8\n\n• опись, т. 9;\nДата выдачи: 01.01.2020 г.\n") == ["Приложение № 8", "• опись, т. 9;", "Дата выдачи: 01.01.2020 г."]
    assert units("区县有误。答复：“齐全。可以。”请核对！") == ["区县有误。", "答复：“齐全。可以。”", "请核对！"]
    assert units("Геодезическая разбивка распределительного устройства\nвыполнена. Да.") == ["Геодезическая разбивка распределительного устройства\nвыполнена.", "Да."]
    assert units(" ​\n") == [] and units("") == []


def test_the_document_outranks_lists_and_corpus():
    units = lambda t, known=frozenset(): [t[a:b] for a, b in sentences.Splitter(known).units(t)]
    assert len(units("Это был проф. Далее шли другие.")) == 1
    assert len(units("Новый проф собрал всех. Старый проф ушёл. Это был проф. Далее шли другие.")) == 4
    assert len(units("Схема по табул. форме. Далее табул. Белый лист.")) == 2 and len(units("Далее табул. Белый лист.")) == 2
    assert len(units("Далее табул. Белый лист.", frozenset({"табул"}))) == 1


def test_long_plain_lines_take_time_in_proportion():
    import time

    text = "Это обычная проза, в которой ничего нет. Работы выполнены согл. плану. " * 2000
    began = time.time()
    assert len(sentences.Splitter().units(text)) == 4000 and time.time() - began < 5


def test_many_learned_words_go_by_join(spark):
    rows = [(1, "см. табул. форму. " * 9), (2, "Далее табул. Белый лист."), (3, None), (4, " "), (4, " "), (5, "Да. Нет."), (5, "Да. Нет.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("units", survivor.F.lit(1))
    want = sorted(map(tuple, sentences.sentence_units(df).collect()))
    assert want == sorted(map(tuple, sentences.sentence_units(df, max_broadcast=0).collect())) and (2, 0, 24) in want and sum(x[0] == 5 for x in want) == 4


def test_every_match_is_fed_to_the_byte_stream(monkeypatch):
    e, fed = tokens.StreamingEncoder(), []
    feed = e.run.feed
    monkeypatch.setattr(e.run, "feed", lambda raw: fed.append(raw) or feed(raw))
    e.encode("Акт № 5 принят")
    assert b"".join(fed).decode() == "Акт № 5 принят"


def scan_lines(spark, texts):
    words = [[(t, 100 + 50 * k, 500, 40, 20, 0.9) for k, t in enumerate(line.split())] for line in texts]
    rows = [(i, 1, i // 40, i % 40, 1000, 1000, w) for i, w in enumerate(words)]
    return spark.createDataFrame(rows + rows[:1], "line_id long, scan_id long, page int, line_no int, page_width int, page_height int, words array<struct<text:string,left:int,top:int,width:int,height:int,confidence:double>>")


def misread(spark, texts):
    return {(r.line_id, r.word_no) for r in ocrnoise.found_noise(scan_lines(spark, texts)).where("kind = 'misread'").collect()}


def test_words_at_line_starts_are_in_the_lexicon(spark):
    texts = [f"Протокол {i}." for i in range(9)] + ["Протонол 10.", "Акт о протоко-", "ле дня."]
    assert misread(spark, texts) == {(9, 1)}
    slim = ocrnoise.token_lines(ocrnoise.body_lines(scan_lines(spark, texts)))
    tokens_ = ocrnoise.token_table(slim)
    split = ocrnoise.divided_words(slim, ocrnoise.place_counts(tokens_))
    counts = {r.w: r.n for r in ocrnoise.lexicon(tokens_, ocrnoise._open_ends(slim, split)).collect()}
    assert counts["протокол"] == 9 and not {"протоко", "ле"} & counts.keys() and counts["акт"] == 1


def test_edit_weights():
    cost = ocrnoise.misreading_cost
    assert cost("раон", "район") == cost("районн", "район") == cost("рацон", "район") == ocrnoise.OTHER_EDIT
    assert cost("рай.он", "район") == ocrnoise.SIGN and cost("rnост", "мост") == ocrnoise.CONFUSION and cost("мст", "мост") is None
    words = ["", "а", "раон", "райо.н", "rnай", "эк", "жук", "bl"]
    for x in words:
        for y in words:
            assert cost(x, y) == brute_cost(x, y), (x, y)


def brute_cost(seen, printed):
    from functools import cache

    @cache
    def d(i, j):
        out = [0.0] if i == j == 0 else []
        if i:
            out.append(d(i - 1, j) + (ocrnoise.SIGN if seen[i - 1] in ocrnoise.NOISE else ocrnoise.OTHER_EDIT))
        if j:
            out.append(d(i, j - 1) + ocrnoise.OTHER_EDIT)
        if i and j:
            a, b = seen[i - 1], printed[j - 1]
            out.append(d(i - 1, j - 1) + (0 if a == b else ocrnoise.CONFUSION if b in ocrnoise.CONFUSED.get(a, "") else ocrnoise.SIGN if a in ocrnoise.NOISE else ocrnoise.OTHER_EDIT))
        if i > 1 and j and (seen[i - 2 : i], printed[j - 1]) in ocrnoise.JOINED:
            out.append(d(i - 2, j - 1) + ocrnoise.CONFUSION)
        return min(out)

    got = d(len(seen), len(printed))
    most = ocrnoise.OTHER_EDIT * (2 if max(len(seen), len(printed)) >= ocrnoise.LONG else 1)
    return got if got < most and abs(len(seen) - len(printed)) <= 3 else None


def test_readings_of_impossible_characters():
    assert ocrnoise.reading("п@рка,") == "парка" and ocrnoise.reading("2O12.05.13") == "2012.05.13" and ocrnoise.reading("район") is None and ocrnoise.reading("№ 5") is None


def test_lost_and_added_letters_are_repaired(spark):
    texts = ["весь новый район города 1."] * 20 + ["весь новый раон города 2.", "весь новый районн города 3.", "весь новый рай.он города 4."]
    slim_split = ocrnoise.scan_noise(scan_lines(spark, texts))
    assert {(r.line_id, r.word_no, r.repair) for r in slim_split[3].collect()} == {(20, 3, "район"), (21, 3, "район"), (22, 3, "район")}


def test_margins_are_where_lines_repeat(spark):
    rows = []
    for page in range(1, 5):
        for no, (text, top) in enumerate([("Том 5", 30), (f"Начало листа {'абвг'[page]}", 90), ("Том 5 описан", 500), (f"Конец {'дежз'[page]}", 900), (f"{page}", 960)] if page < 4 else [("Глава", 90), ("4", 960)]):
            rows.append((page * 10 + no, 1, page, no, 1000, 1000, [(w, 100 + 60 * k, top, 50, 20, 0.9) for k, w in enumerate(text.split())]))
    lines = spark.createDataFrame(rows + [(99, 1, 9, 0, 1000, 1000, None)], "line_id long, scan_id long, page int, line_no int, page_width int, page_height int, words array<struct<text:string,left:int,top:int,width:int,height:int,confidence:double>>")
    got = {r.line_id for r in ocrnoise.found_noise(lines).where("kind = 'furniture'").collect()}
    assert got == {10, 14, 20, 24, 30, 34, 41}
    assert ocrnoise.found_noise(lines.where("false")).count() == 0


def test_paragraphs_go_on_over_pages(spark):
    word = lambda t, left: (t, left, 500, 40, 20, 0.9)
    rows = [(1, 1, 1, 1, 1000, 1000, [word("Первый", 140), word("протоко-", 200)]), (2, 1, 2, 1, 1000, 1000, [word("ле", 100), word("дня.", 150)]), (3, 1, 2, 2, 1000, 1000, [word("Второй", 140), word("абзац.", 200)]), (4, 1, 1, 2, 1000, 1000, [word("строка", 100), word("первого", 150)])]
    rows[0], rows[3] = (1, 1, 1, 1, 1000, 1000, [word("Первый", 140), word("абзац", 200)]), (4, 1, 1, 2, 1000, 1000, [word("с", 100), word("протоко-", 150)])
    lines = spark.createDataFrame(rows, "line_id long, scan_id long, page int, line_no int, page_width int, page_height int, words array<struct<text:string,left:int,top:int,width:int,height:int,confidence:double>>")
    got = [(r.page, r.first_line, r.text) for r in ocrnoise.paragraphs(lines).orderBy("page", "first_line").collect()]
    assert got == [(1, 1, "Первый абзац с протоколе дня."), (2, 2, "Второй абзац.")]


@pytest.mark.parametrize("times", [1, 10])
def test_misreadings_are_certain_at_every_size(spark, times):
    texts = ["Протокол 1."] * 16 * times + ["Протонол 10."] * times
    assert misread(spark, texts) == {(i, 1) for i in range(16 * times, 17 * times)}


def test_edits_that_are_no_confusion(spark):
    assert ocrnoise.misreading_cost("несяцев", "месяцев") == ocrnoise.misreading_cost("месяев", "месяцев") == ocrnoise.OTHER_EDIT
    texts = ["срок восемь месяцев подряд 1."] * 20 + ["срок восемь несяцев подряд 2.", "срок восемь месяев подряд 3.", "срок восемь месяца назад 4."] + ["новый офис-центр построен 5."] * 20 + ["новый офис-пентр построен 6."]
    assert misread(spark, texts) == {(20, 3), (21, 3), (43, 2)}


@pytest.mark.parametrize("times", [1, 10])
def test_divisions_are_judged_alike_at_every_size(spark, times):
    texts = ["Акт наблю-", "дения здесь."] * times + ["тут наблю дения там"] * times + ["весь протокол готов"] * 100 * times + ["часть прото кол пуста"] * times * 3 + ["Здесь прото", "кол верен."]
    found = ocrnoise.found_noise(scan_lines(spark, texts)).where("kind = 'split'")
    assert {r.line_id for r in found.collect()} == {*range(0, 2 * times, 2), len(texts) - 2}


def test_short_texts_are_streamed(monkeypatch):
    e, asked = tokens.StreamingEncoder(), []
    whole = e.stream
    monkeypatch.setattr(e, "stream", lambda blocks: asked.append(1) or whole(blocks))
    assert e.encode("Акт № 5") and e.encode("") == [] and len(asked) == 2
