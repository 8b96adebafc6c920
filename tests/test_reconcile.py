import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_merge import record
from vedomost.operators import reconcile as rc
from vedomost.operators import summary
from vedomost.operators.copydiff import diff_copies, register_copy_diff
from vedomost.operators.merge import merge_versions
from vedomost.schemas import RECORD

REGISTER = "row_no int, reg_id long, number string, stage string, object string, issue date, end_date date, changed date, issuer string, builder string, region string, district string, developer string, link string, status string"
N = "RU-12345678-09-2026"


def row(row_no, number, **v):
    base = {k.split()[0]: None for k in REGISTER.split(", ")} | {"row_no": row_no, "reg_id": row_no - 3, "number": number} | v
    return tuple(base.values())


def run(spark, rows, records):
    reg = rc.register_cells(spark.createDataFrame(rows, REGISTER))
    return reg, rc.reconcile(merge_versions(spark.createDataFrame(records, RECORD)), reg)


def test_outcomes(spark):
    rows = [
        row(4, f"№ {N}", builder="ООО А"), row(5, "38-07-02-2025", stage="Этап 1.1"), row(6, "38-07-02-2025"), row(7, "RU-11111111-01-2020", builder="ООО «Б»", end_date=datetime.date(2027, 1, 1)),
    ]
    recs = [
        record("p1.pdf", builder="ООО «А»", stage="Этап 2.1"), record("p2.pdf", number="38-07-02-2025", stage="x"), record("p3.pdf", number="RU-11111111-01-2020", builder="ООО В", end="01.01.2027"),
        record("изменение.pdf", number="RU-22222222-01-2020", stage="y"), record("p5.pdf", number="RU-33333333-01-2020", stage="z"),
    ]
    reg, ch = run(spark, rows, recs)
    got = {r.number: r for r in ch.collect()}
    assert {n: r.outcome for n, r in got.items()} == {N: "updated", "38-07-02-2025": "review_conflict", "RU-11111111-01-2020": "review", "RU-22222222-01-2020": "review_conflict", "RU-33333333-01-2020": "added"}
    c = {(r.number, r.field): r for r in rc.conflicts(ch).collect()}
    assert c["RU-11111111-01-2020", "builder"].existing == "ООО «Б»" and len(c) == 3
    after = rc.apply_changes(reg, ch)
    a = {r.row_no: r for r in after.collect()}
    assert a[4].stage == "Этап 2.1" and a[4].builder == "ООО А" and a[8].number == "RU-33333333-01-2020" and a[8].reg_id == 5
    assert a[7].builder == "ООО «Б»" and a[7].status.startswith("Не перенесено «Застройщик»")
    assert rc.check_publication(reg, after, ch).count() == 0
    again = rc.reconcile(merge_versions(spark.createDataFrame(recs, RECORD)), after)
    assert {r.outcome for r in again.collect()} <= {"already_present", "review", "review_conflict"} and again.where("physical_mutation").count() == 0
    s = summary.run_summary(ch).first()
    assert (s.record_count, s.new_rows, s.conflicts, s.review_rows) == (5, 1, 3, 3)
    docs = spark.createDataFrame([("/in/p3.pdf", "d3")], "pdf string, document_id string")
    p = summary.proposals(ch, docs).collect()
    assert [(x.field, x.status, x.document_id) for x in p] == [("builder", "pending", "d3")]
    fixed = rc.approve_values(after, spark.createDataFrame([(7, "builder", "ООО В")], "row_no int, field string, value string")).where("row_no = 7").first()
    assert fixed.builder == "ООО В" and fixed.status is None


def test_manual_edit_keeps_the_link_and_marks_the_row(spark):
    reg = rc.register_cells(spark.createDataFrame([row(4, N, builder="ООО А", stage="1", link="a.pdf", status="Не перенесено «Застройщик»: x\nзаметка"), row(5, N, status="s")], REGISTER))
    edits = spark.createDataFrame([(4, "builder", "ООО Б"), (4, "stage", None), (9, "stage", "z"), (4, "nothing", "z")], "row_no int, field string, value string")
    got = {r.row_no: r for r in rc.edit_values(reg, edits).collect()}
    assert (got[4].builder, got[4].stage, got[4].link) == ("ООО Б", None, "a.pdf")
    assert got[4].status == "заметка\nИсправлено вручную: «Застройщик», «Номер этапа»." and got[5].status == "s"
    approved = rc.approve_values(reg, spark.createDataFrame([(4, "builder", "ООО В", "b.pdf")], "row_no int, field string, value string, filename string")).where("row_no = 4").first()
    assert (approved.builder, approved.link, approved.status) == ("ООО В", "b.pdf", "заметка")


def test_status_column():
    assert rc.status_column(None) and rc.status_column("") and not rc.status_column(rc.STATUS_HEADER)
    with pytest.raises(RuntimeError):
        rc.status_column("Прочее")


def test_blocked_numbers_say_why(spark):
    rows = [row(4, f"{N}; 38-07-02-2025"), row(5, "RU-11111111-01-2020"), row(6, "RU-11111111-01-2020")]
    _, ch = run(spark, rows, [record("a.pdf", stage="x"), record("b.pdf", number="RU-11111111-01-2020", stage="x"), record("приказ.pdf", number="RU-22222222-01-2020", stage="x")])
    said = {r.number: r.existing for r in rc.conflicts(ch).collect()}
    assert said == {N: "несколько номеров РНС в ячейке Excel", "RU-11111111-01-2020": "несколько строк Excel", "RU-22222222-01-2020": "строка Excel не найдена"}


def test_weak_values_are_shown_not_written(spark):
    rec = record("p.pdf", builder="ООО А", stage="Этап 1.1") | {"field_quality": {"builder": ("review", "low_ocr_confidence", 24.0)}}
    _, ch = run(spark, [row(4, N)], [rec])
    r = ch.first()
    assert r.outcome == "review" and r.written == ["stage"]
    _, ch = run(spark, [], [rec])
    assert ch.first().outcome == "review" and ch.first().new


def test_number_only_and_several_in_a_cell(spark):
    _, ch = run(spark, [row(4, f"{N}; 38-07-02-2025"), row(5, "RU-11111111-01-2020", status="заметка")], [record("a.pdf", stage="x"), record("b.pdf", number="RU-11111111-01-2020")])
    got = {r.number: r for r in ch.collect()}
    assert got[N].outcome == "review_conflict"
    assert got["RU-11111111-01-2020"].status == rc.NO_EVIDENCE + "\nзаметка"


def test_copies_differ_as_brute_force_says(spark):
    left = [(1, "a", "x"), (1, "a", "x"), (2, "b", None), (3, "c", "y"), (None, "n", "n")]
    right = [(1, "a", "x"), (2, "b", "z"), (4, "d", "w"), (None, "n", "n")]
    f = {"p": F.col("p"), "q": F.col("q")}
    schema = "k int, p string, q string"
    got = {(r.k, r.field) for r in diff_copies(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", f, f).collect()}
    assert got == {(2, "q"), (3, None), (4, None)}
    multi = {(r.k, r.field) for r in diff_copies(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", f, f, multiset=True).collect()}
    assert (1, None) in multi and (2, "q") in multi
    assert diff_copies(spark.createDataFrame([], schema), spark.createDataFrame([], schema), "k", f, f).count() == 0


@pytest.mark.parametrize(
    ("number", "end", "builder", "diffs"),
    [
        ("ru 12345678 09 2026", "до 02.10.2026 г.", "ооо “а б”.", set()),
        ("RU-1234567\u200b8-О9-2О26", "2026-10-02", "OOO А-Б", set()),
        ("RU-12345678-9-2026", "31.02.2026", "ООО А", {"number", "end_date", "builder"}),
        (None, None, " ", {"number", "end_date", "builder"}),
    ],
)
def test_register_and_copy(spark, number, end, builder, diffs):
    r = spark.createDataFrame([(1, N, datetime.date(2026, 10, 2), "ООО «А Б»")], "reg_id long, number string, end_date date, builder string")
    old = (1, 1, "other", "01.01.2000", "x", datetime.datetime(2020, 1, 1))
    c = spark.createDataFrame([old, (2, 1, number, end, builder, datetime.datetime(2021, 1, 1))], "copy_id long, reg_id long, number string, end_date string, builder string, synced_at timestamp")
    assert {x.diff for x in register_copy_diff(r, c).collect()} == diffs


def test_skewed_key(spark):
    r = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("v").alias("p"))
    assert diff_copies(r, r.dropDuplicates(), "k", {"p": F.col("p")}, {"p": F.col("p")}).count() == 0
