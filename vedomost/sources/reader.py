"""The document reader as a plug-in.

A reader is a function from one request to one reading; it runs in the tasks, one document at a time, inside a
single ``mapInPandas`` so that the second way (images) is tried only where the first (text layer) gave nothing.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from vedomost.schemas import LINE

READ_SCHEMA = f"pdf string, filename string, dpi int, max_pages int, force_raster boolean, text string, lines array<{LINE}>, source string, total_pages int, error string"
# Time limits in seconds.
COUNT_LIMIT, TEXT_LIMIT = 30, 90


@dataclass
class Reading:
    text: str = ""
    lines: list = field(default_factory=list)
    source: str = "text_layer"
    total_pages: int = 0


def routed(text_layer: Callable[[str, int], str | None], raster: Callable[[str, int, int], Reading], pages: Callable[[str], int]) -> Callable[[str, int, int, bool], Reading]:
    """A reader that takes the text layer unless it is blank or images are forced; max_pages 0 means all, the page count is the total."""

    def read(pdf: str, dpi: int, max_pages: int, force: bool) -> Reading:
        total = pages(pdf)
        text = None if force else text_layer(pdf, max_pages)
        if text and text.strip():
            return Reading(text, [], "text_layer", total)
        got = raster(pdf, dpi, max_pages)
        return Reading(got.text, got.lines, "raster", total)

    return read


def reader_plugin(read: Callable[[str, int, int, bool], Reading]) -> Callable[[DataFrame], DataFrame]:
    """``read`` over a DataFrame of requests; an exception becomes the row's error."""

    def one(pdf: str, filename: str, dpi: int, max_pages: int, force: bool) -> tuple:
        try:
            r = read(pdf, dpi, max_pages, force)
            return pdf, filename, dpi, max_pages, force, r.text, r.lines, r.source, r.total_pages, None
        except Exception as e:  # noqa: BLE001 - any failure of a reader belongs to its document
            return pdf, filename, dpi, max_pages, force, None, None, None, None, f"{type(e).__name__}: {e}"

    names = [x.split()[0] for x in READ_SCHEMA.replace(LINE, "line").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):  # one document per batch: a reading may be large
                yield pd.DataFrame([one(row.pdf, row.filename, int(row.dpi), int(row.max_pages), bool(row.force_raster))], columns=names)

    return lambda requests: requests.select("pdf", "filename", "dpi", "max_pages", "force_raster").mapInPandas(run, READ_SCHEMA)


def native_text_layer(pdf: str, max_pages: int) -> str | None:
    """The text layer by the native tool; None for a missing tool, a failure, a timeout or blank text."""
    tool = shutil.which("pdftotext")
    if tool is None:
        return None
    pages = ["-l", str(max_pages)] if max_pages > 0 else []
    try:
        done = subprocess.run([tool, "-f", "1", *pages, "-layout", pdf, "-"], capture_output=True, timeout=TEXT_LIMIT, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    text = done.stdout.decode("utf-8", errors="replace")
    return text if text.strip() else None


def native_page_count(pdf: str) -> int:
    """The number of pages by the native tool; each kind of failure has its own error."""
    tool = shutil.which("pdfinfo")
    if tool is None:
        raise RuntimeError("page_count_tool_missing")
    try:
        done = subprocess.run([tool, pdf], capture_output=True, timeout=COUNT_LIMIT, check=True, text=True)
    except subprocess.TimeoutExpired:
        raise RuntimeError("page_count_timeout") from None
    except (OSError, subprocess.SubprocessError):
        raise RuntimeError("page_count_failed") from None
    line = next((x for x in done.stdout.splitlines() if x.startswith("Pages:")), "")
    try:
        return int(line.split(":", 1)[1])
    except (IndexError, ValueError):
        raise RuntimeError("page_count_unreadable") from None


def health(tools: tuple[str, ...] = ("pdfinfo", "pdftotext", "pdftoppm", "tesseract")) -> dict[str, bool]:
    """Which native tools this machine has."""
    return {t: shutil.which(t) is not None for t in tools}
