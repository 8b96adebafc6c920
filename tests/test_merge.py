import itertools
import random

import pytest

from vedomost.operators.merge import merge_sources, merge_versions, unlinked_directives
from vedomost.schemas import RECORD

FIELDS = [x.split()[0].strip("`") for x in RECORD.split(", ")][:16]


def record(filename, number="RU-12345678-09-2026", **values):
    base = dict.fromkeys(("issue", "end", "changed", "issuer", "developer", "builder", "district", "region", "stage", "object"))
    base |= values
    return {"number": number, **base, "pdf": f"/in/{filename}", "filename": filename, "number_source": "content", "field_provenance": {k: "ocr" for k, v in values.items() if v}, "warnings": [k for k, v in base.items() if v is None], "field_quality": None}


def merged(spark, rows):
    return [r.asDict() for r in merge_versions(spark.createDataFrame(rows, RECORD)).collect()]


@pytest.mark.parametrize(("end", "wins"), [("02.01.2027", True), ("01.01.2027", False), ("31.12.2026", False), ("31.02.2030", False)])
def test_only_a_strictly_later_day_replaces(spark, end, wins):
    (m,) = merged(spark, [record("permit.pdf", end="01.01.2027", stage="Этап 1.1"), record("продление.pdf", end=end)])
    assert m["end"] == (end if wins else "01.01.2027")
    assert m["filename"] == ("продление.pdf" if wins else "permit.pdf")


def test_every_order_gives_the_same_record(spark):
    rows = [record("permit.pdf", end="01.01.2027", issuer="Орган"), record("изменение a.pdf", changed="05.05.2026", builder="ООО «А»"), record("продление b.pdf", end="01.01.2028", builder="ооо а")]
    seen = set()
    for order in itertools.permutations(rows):
        (m,) = merged(spark, list(order))
        seen.add(repr({k: m[k] for k in sorted(m)}))
    assert len(seen) == 1
    (m,) = merged(spark, rows)
    assert (m["end"], m["changed"], m["builder"], m["filename"], m["merge_issues"]) == ("01.01.2028", "05.05.2026", "ооо а", "изменение a.pdf", [])


def test_disagreeing_amendments_are_an_issue(spark):
    (m,) = merged(spark, [record("permit.pdf", stage="Этап 1.1"), record("изменение 1.pdf", issuer="А"), record("изменение 2.pdf", issuer="Б")])
    assert m["issuer"] is None and [i["code"] for i in m["merge_issues"]] == ["conflicting_directive_field:issuer"]
    assert "issuer" in m["warnings"] and "conflicting_directive_field:issuer" in m["warnings"]


def test_amendments_only_and_empty_amendments(spark):
    rows = [record("изменение.pdf", builder="ООО А", end="01.01.2027"), record("приказ.pdf")]
    (m,) = merged(spark, rows)
    assert m["existing_only"] and m["builder"] == "ООО А" and m["n_linked"] == 1
    df = spark.createDataFrame(rows, RECORD)
    assert [r.filename for r in unlinked_directives(df).collect()] == ["приказ.pdf"]
    assert {r.filename for r in merge_sources(df).collect()} == {"изменение.pdf", "приказ.pdf"}


def test_bad_dates_repeats_nulls_and_nothing(spark):
    rows = [record("permit.pdf", end="31.02.2027", stage="Этап 1.1")] * 2 + [record("x.pdf", number=None, stage="s")]
    got = {m["number"]: m for m in merged(spark, rows)}
    assert got["RU-12345678-09-2026"]["end"] is None and "invalid_date:end" in got["RU-12345678-09-2026"]["warnings"]
    assert got[None]["stage"] == "s"
    assert merged(spark, []) == []


def test_hot_permit(spark):
    rows = [record(f"изменение {i}.pdf", changed=f"{1 + i % 28:02}.0{1 + i % 9}.2025") for i in range(500)] + [record("permit.pdf", stage="Этап 1.1")]
    random.Random(1).shuffle(rows)
    (m,) = merged(spark, rows)
    assert m["n_versions"] == 501 and m["changed"] == max((r["changed"] for r in rows if r["changed"]), key=lambda x: x.split(".")[::-1])
