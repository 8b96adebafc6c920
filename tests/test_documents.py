import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vedomost.operators import extract, history, layout, mapping, routing
from vedomost.operators.merge import merge_versions
from vedomost.schemas import LINE, RECORD
from vedomost.sinks import publish
from vedomost.sources import discovery, ooxml, reader
from vedomost.streaming.versions import current_merged, merge_stream

N = "RU-12345678-09-2026"


def word(text, left, top=10, width=60, confidence=90.0):
    return (text, left, top, width, 20, confidence)


def line(*words, page=1):
    return (page, 1000, 1400, list(words))


def docs(spark, *rows):
    return spark.createDataFrame([(i, f"/in/{name}", name, text, lines, source) for i, (name, text, lines, source) in enumerate(rows)], f"doc_id int, pdf string, filename string, text string, lines array<{LINE}>, source string")


@pytest.mark.parametrize(
    ("name", "text", "number"),
    [
        ("permit.pdf", f"№{N}", N),
        ("RU_12345678_09_2026.pdf", "", N),
        ("38-07-02-2025.pdf", f"{N} и 38-1-2-2026", None),
        ("x.pdf", f"Номер разрешения на строительство: {N}\nЗастройщик: А, ранее 38-1-2-2026", N),
        ("38-07-02-2025.pdf", f"строительство: номер разрешения на {N}\nстроительство: номер разрешения на {N}", None),
        ("x.pdf", None, None),
    ],
)
def test_identity_cascade(spark, name, text, number):
    got = extract.with_identity(docs(spark, (name, text or "", None, "text_layer"))).first()
    assert got.number == number


def test_dates_first_last_latest(spark):
    text = f"Разрешение {N}\nДата выдачи: 01.02.2020, 31.02.2020\nСрок действия: 01.01.2026 продлён 01.01.2025\nДата последнего изменения: 05.05.2021\nДата внесения изменений: 04.04.2022\nЭтап 4.5\n"
    r = extract.extract_records(docs(spark, ("permit.pdf", text, None, "text_layer"))).first()
    assert (r.issue, r.end, r.changed, r.stage) == ("01.02.2020", "01.01.2025", "04.04.2022", "Этап 4.5")
    assert "invalid_date:issue" in r.warnings and r.field_quality is None


def test_layout_value_and_quality(spark):
    lines = [line(word("Застройщик", 50, width=120), word("ООО", 600, 30), word("Ромашка", 700, 30, confidence=24.0)), line(word("плюс", 600, 50)), line(word("Этап", 50, 80))]
    text = "\n".join(" ".join(w[0] for w in x[3]) for x in lines) + f"\n{N}"
    d = docs(spark, ("permit.pdf", text, lines, "raster"))
    assert d.select(layout.label_block(F.col("lines"), "застройщик")).first()[0] == "ООО Ромашка плюс"
    r = extract.extract_records(d).first()
    assert r.builder == "ООО Ромашка плюс" and r.field_quality["builder"].status == "review" and r.field_quality["builder"].confidence == 24.0


def test_tsv(spark):
    cells = [["1", "1", "0", "0", "0", "0", "0", "0", "1000", "1400", "-1", ""], ["5", "1", "1", "1", "1", "2", "200", "11", "50", "20", "90", "б"], ["5", "1", "1", "1", "1", "1", "100", "10", "50", "20", "91", "а"], ["5", "x", "1"], ["5", "1", "1", "1", "2", "1", "100", "50", "50", "20", "91", "в"]]
    rows = spark.createDataFrame([(1, 1, i, c) for i, c in enumerate(cells)], "doc_id int, page int, seq int, cells array<string>")
    d = layout.document_text(layout.parse_tsv(rows)).first()
    assert d.text == "а б\nв" and d.lines[0].page_width == 1000
    assert layout.parse_tsv(rows.where("false")).count() == 0


def test_routing_reads_no_document_twice_and_skips_by_name(spark, tmp_path):
    log = tmp_path / "log"

    def read(pdf, dpi, max_pages, force):
        with open(log, "a") as f:
            f.write(f"{pdf} {dpi} {max_pages} {force}\n")
        if "bad" in pdf:
            raise RuntimeError("page_count_failed")
        return reader.Reading(N if force and "разрешение" in pdf else "ничего", [], "raster" if force else "text_layer", 30)

    names = ["разрешение.pdf", "ГПЗУ 1.pdf", "bad.pdf", "прочее.pdf"]
    paths = spark.createDataFrame([(f"/in/{n}", n) for n in names], "pdf string, filename string")
    identify = lambda df: extract.with_identity(df.withColumn("text", F.coalesce("text", F.lit(""))))
    out = {r.filename: r for r in routing.read_documents(paths, reader.reader_plugin(read), identify).collect()}
    assert {n: r.outcome for n, r in out.items()} == {"разрешение.pdf": "processed_rns", "ГПЗУ 1.pdf": "out_of_scope", "bad.pdf": "processing_failed", "прочее.pdf": "unidentified_permit"}
    calls = sorted(log.read_text().splitlines())
    assert len(calls) == len(set(calls)) == 5 and "/in/разрешение.pdf 180 10 True" in calls and not any("ГПЗУ" in c for c in calls)
    assert out["разрешение.pdf"].route == "text_layer_then_raster"


def test_images_are_read_page_by_page():
    from vedomost.sources import raster

    head = "\t".join(layout.TSV_COLUMNS)
    tsv = lambda text: f"{head}\n1\t1\t0\t0\t0\t0\t0\t0\t1000\t1400\t-1\t\n5\t1\t1\t1\t1\t2\t200\t11\t50\t20\t90\tб\n5\tx\n5\t1\t1\t1\t1\t1\t100\t10\t50\t20\t91\t{text}\n"
    pages = {1: tsv("а"), 2: head + "\n", 3: "просто текст", 4: tsv("г"), 5: tsv("д")}
    drawn = []
    read = raster.raster_reader(lambda pdf, page, dpi: drawn.append((page, dpi)) or str(page).encode(), lambda image: pages[int(image)], lambda pdf: 5)
    got = read("x.pdf", 300, 4)
    assert got.text == "а б\n\nпросто текст\nг б" and [x["page"] for x in got.lines] == [1, 4] and got.total_pages == 5 and sorted(drawn) == [(p, 300) for p in (1, 2, 3, 4)]
    assert len(read("x.pdf", 300, 0).text.splitlines()) == 5

    def broken(pdf, page, dpi):
        raise RuntimeError("pdf_render_failed")

    with pytest.raises(RuntimeError):
        raster.raster_reader(broken, str, lambda pdf: 1)("x.pdf", 300, 0)


def test_traces(spark):
    from vedomost.schemas import TRACE

    trace = lambda route, calls: (1, route, 180, 180, 5, 5, calls, calls > 0, "old", (1, 1, 1, 1, -4), 0, 0, 0)
    df = spark.createDataFrame([(trace("text_layer", 0), trace("raster", 3)), (trace("raster", 2), trace("raster", 3))], f"a {TRACE}, b {TRACE}")
    got = [r.t for r in df.select(routing.combined_trace(F.col("a"), F.col("b"), F.lit("identity_missing")).alias("t")).collect()]
    assert [(g.route, g.tesseract_calls, g.ocr_calls, g.fallback_reason, g.timings_ms.page_count, g.timings_ms.total) for g in got] == [("text_layer_then_raster", 3, 3, "identity_missing", 2, 0), ("raster", 5, 5, "identity_missing", 2, 0)]
    failed = df.select(routing.failure_trace(400, F.lit("boom"), F.lit(7)).alias("t")).first().t
    assert (failed.route, failed.dpi, failed.pages, failed.fallback_reason, failed.timings_ms.total) == ("failed", 400, 0, "boom", 7)


def test_only_the_last_finished_jobs_stay(spark):
    from vedomost.operators.summary import keep_last

    jobs = spark.createDataFrame([(i, "done", i, False) for i in range(5)] + [(9, "running", None, None), (8, "done", -1, True)], "job_id int, status string, finished_at int, in_flight boolean")
    assert {r.job_id for r in keep_last(jobs, 2).collect()} == {3, 4, 8, 9}


def test_candidates_all_or_nothing(spark):
    base = (N, *[None] * 10, "/p", "p", "content", {}, ["builder", "region"], None)
    schema = RECORD + f", mapping_candidates {mapping.CANDIDATES}, assignments {mapping.ASSIGNMENTS}"
    good = [("c1", "ООО А", ["builder"])]
    df = spark.createDataFrame([(*base, good, [("c1", "builder")]), (*base, good, [("c1", "region")]), (*base, good * 2, [("c1", "builder")] * 2), (*base, None, None)], schema)
    got = [(r.builder, r.field_provenance, r.warnings) for r in mapping.apply_assignments(df).collect()]
    assert got[0] == ("ООО А", {"builder": "mapping_llm"}, ["region"]) and all(g[0] is None for g in got[1:])


def test_history_and_actions(spark):
    ok = [("manual_edit", 4, "Застройщик", "edited")]
    h = "a" * 64
    states = spark.createDataFrame([(1, "v1", h, h, ok), (2, "v1", h, "b" * 64, ok), (3, "v1", h, h, [("manual_edit", 3, "Застройщик", "edited")]), (4, None, None, h, None), (5, "v2", h, h, ok)], "id int, schema string, register_sha256 string, current_sha256 string, actions array<struct<type:string,row:int,field:string,status:string>>")
    got = {r.id: (r.accepted, r.warning) for r in history.validate_histories(states, "v1").collect()}
    assert got == {1: (True, None), 2: (False, "stale"), 3: (False, "invalid"), 4: (False, None), 5: (False, "invalid")}
    a = spark.createDataFrame([(1, N, "builder", "approve", "А", 1), (2, N, "builder", "manual_edit", "Б", 1), (3, N, "builder", "manual_edit", "В", 2), (4, N, "end", "manual_edit", "40.01.2026", 1)], "seq int, number string, field string, kind string, value string, version int")
    r = history.resolve_actions(a)
    assert {x.seq: (x.status, x.current) for x in r.collect()} == {1: ("approved", False), 2: ("stale", False), 3: ("edited", True), 4: ("invalid", False)}
    p = spark.createDataFrame([(N, "builder", "approved")], "number string, field string, status string")
    assert history.resolve_proposals(p, r).first().status == "resolved_manual" and history.action_events(r).count() == 2


def test_discovery_and_reports(spark, tmp_path):
    for n in ("b.PDF", "_a.pdf", "c.txt"):
        (tmp_path / n).write_text("x")
    (tmp_path / "l.pdf").symlink_to(tmp_path / "b.PDF")
    assert [p.rsplit("/", 1)[1] for p in discovery.list_documents(str(tmp_path))] == ["_a.pdf", "b.PDF"]
    assert discovery.document_paths(spark, str(tmp_path)).count() == 2
    assert discovery.read_report(str(tmp_path / "none")) == (None, None)
    assert discovery.read_report(str(tmp_path / "l.pdf"))[1] == "unreadable"
    (tmp_path / "r.json").write_text("[1]")
    assert discovery.read_report(str(tmp_path / "r.json")) == (None, "invalid")
    publish.write_report(str(tmp_path / "r.json"), {"path": "/a/b.pdf", "token": 1})
    assert json.loads((tmp_path / "r.json").read_text()) == {"path": "b.pdf"}


def test_spreadsheet_source(spark, tmp_path):
    path = tmp_path / "r.xlsx"
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{m}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>{N}</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="4"><c r="A4"><v>1</v></c><c r="F4" t="s"><v>0</v></c><c r="H4" s="1"><v>46000</v></c><c r="Y4"><f>A4+1</f><v>2</v></c></row></sheetData></worksheet>')
    ooxml.register_source(spark)
    cells = spark.read.format("ooxml_register").option("sheet", "S").load(str(path))
    assert {x.col: x.value for x in cells.collect()} == {"A": "1", "F": N, "H": "09.12.2025", "Y": "=A4+1"}
    row = ooxml.register_rows(cells).first()
    assert (row.row_no, row.reg_id, row.number, row.end) == (4, 1, N, "09.12.2025")


def test_publication_is_all_or_nothing(spark, tmp_path):
    target = str(tmp_path / "reg")
    reg = spark.createDataFrame([(4, "a")], "row_no int, number string")
    changed = spark.createDataFrame([(True,)], "physical_mutation boolean")
    first = publish.publish(reg, changed, target)
    assert publish.current_version(target) == first and publish.read_current(spark, target).count() == 1
    assert publish.publish(reg, changed.where("false"), target) is None
    with pytest.raises(RuntimeError):
        publish.publish(reg, changed, target, check=lambda df: df)
    with pytest.raises(RuntimeError):
        publish.publish(reg, changed, target, expected="v-other")
    assert publish.current_version(target) == first and len([p for p in (tmp_path / "reg").iterdir() if p.is_dir()]) == 1


def test_final_state_holds_what_fits_its_schema():
    edit = {"type": "manual_edit", "row": 4, "field": "f", "status": "edited"}
    got = publish.final_state("v1", "a" * 64, True, warning=" a  b ", summary={"conflicts": True, "new_rows": 2, "x": 1, "row_numbers": [4, 5], "new_row_numbers": [4, True]}, proposals=[{"row": 4, "secret": 1, "field": ["x"]}, 7], actions=[edit, {"type": "y"}, edit | {"row": True}])
    assert got["summary"] == {"new_rows": 2, "row_numbers": [4, 5]} and got["proposals"] == [{"row": 4}] and got["actions"] == [edit] and got["row_cards"] == [] and got["warning"] == "a b" and got["status"] == "done"
    with pytest.raises(ValueError):
        publish.final_state("v1", "short", True)


def test_digests_of_inputs(tmp_path):
    assert publish.input_digest("r", {"a": "1", "b": "2"}) == publish.input_digest("r", {"b": "2", "a": "1"}) != publish.input_digest("r", {"a": "2", "b": "1"})
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a").write_text("1")
    first = publish.directory_digest(str(tmp_path))
    (tmp_path / "x" / "b").symlink_to(tmp_path / "x" / "a")
    assert publish.directory_digest(str(tmp_path)) == first
    (tmp_path / "x" / "a").write_text("2")
    assert publish.directory_digest(str(tmp_path)) != first


def test_streamed_versions_equal_the_batch(spark, tmp_path):
    from tests.test_merge import record

    rows = [record("permit.pdf", end="01.01.2027", stage="s"), record("продление.pdf", end="01.01.2028"), record("p.pdf", number="38-1-2-2026", stage="t")]
    src = str(tmp_path / "in")
    for part in (rows[:1], rows[1:]):
        spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).json(src)
    merge_stream(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = current_merged(spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")))
    want = merge_versions(spark.createDataFrame(rows, RECORD))
    key = lambda df: sorted((r.number, r.end, r.stage, r.filename) for r in df.collect())
    assert key(got) == key(want)
