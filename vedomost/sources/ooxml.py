"""Registers in spreadsheet files, as a Python data source: ``spark.read.format("ooxml_register").option("sheet", ...).load(path)``.

Cells keep their formulas as text; styles are read only as far as they tell dates from numbers.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_IDS = {*range(14, 23), *range(45, 48)}


def _letters(ref: str) -> str:
    return re.match(r"[A-Z]+", ref)[0]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_M}numFmt") if re.search(r"[dy]", re.sub(r"\[[^]]*\]|\"[^\"]*\"", "", f.get("formatCode", "")), re.I)}
    xfs = root.find(f"{_M}cellXfs")
    return {i for i, x in enumerate(xfs if xfs is not None else ()) if int(x.get("numFmtId", 0)) in _DATE_IDS | own}


def read_sheet(path: str, sheet: str | None = None) -> Iterator[tuple[int, str, str]]:
    """(row, column letters, text) of each filled cell; dates as dd.mm.yyyy, formulas as ``=...``."""
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{_M}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(z)
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = {s.get("name"): s.get(f"{_R}id") for s in book.iter(f"{_M}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}")
        rid = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = rels[rid].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, c in ElementTree.iterparse(f):
                if c.tag == f"{_M}row":
                    c.clear()
                if c.tag != f"{_M}c":
                    continue
                ref, kind, formula, value = c.get("r"), c.get("t"), c.find(f"{_M}f"), c.find(f"{_M}v")
                if formula is not None:
                    text = "=" + (formula.text or "")
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    text = shared[int(value.text)]
                elif kind is None and int(c.get("s", -1)) in dates:
                    text = (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(value.text))).strftime("%d.%m.%Y")
                else:
                    text = value.text
                yield int(re.search(r"\d+", ref)[0]), _letters(ref), text


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.options["path"].split(",")]

    def read(self, partition: _File) -> Iterator[tuple]:
        for row, column, text in read_sheet(partition.path, self.options.get("sheet")):
            yield partition.path, row, column, text


class OoxmlRegister(DataSource):
    """Cells of a sheet in long form."""

    @classmethod
    def name(cls) -> str:
        return "ooxml_register"

    def schema(self) -> str:
        return "path string, row_no int, col string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(OoxmlRegister)


# The register's columns.
COLUMNS = {"reg_id": "A", "stage": "B", "object": "D", "number": "F", "issue": "G", "end": "H", "changed": "I", "issuer": "J", "builder": "K", "region": "L", "district": "M", "developer": "N", "link": "W", "note": "X", "status": "AA"}
FIRST_DATA_ROW = 4


def register_rows(cells):
    """One row per sheet row from 4 on, with the register's column names; rows without any cell do not exist."""
    from pyspark.sql import functions as F

    one = lambda c: F.max(F.when(F.col("col") == c, F.col("value")))
    wide = cells.where(F.col("row_no") >= FIRST_DATA_ROW).groupBy("row_no").agg(*[one(c).alias(f) for f, c in COLUMNS.items()])
    return wide.withColumn("reg_id", F.expr("try_cast(try_cast(reg_id AS double) AS bigint)"))
