"""Scanned documents read as images: pages drawn, recognised and put together, without a file on the way.

A page is drawn to a pipe and recognised from it; two pages at a time are in hand, so memory is two images whatever the
document's length. The two steps are functions of their own, which tests replace.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from vedomost.operators.layout import TSV_COLUMNS
from vedomost.sources.reader import Reading, native_page_count

# Pages in hand, time limits in seconds, languages and page layout mode of the recognition.
AT_ONCE, DRAW_LIMIT, RECOGNISE_LIMIT = 2, 600, 120
RECOGNISE_OPTIONS = ("-l", "rus+eng", "--oem", "1", "--psm", "6", "-c", "tessedit_create_tsv=1")
_NEEDED = {"level", "page_num", "left", "top", "width", "height", "conf", "text"}


def _piped(command: list[str], limit: int, name: str, data: bytes | None = None) -> bytes:
    if shutil.which(command[0]) is None:
        raise RuntimeError(f"{command[0]}_unavailable")
    try:
        done = subprocess.run(command, input=data, capture_output=True, timeout=limit, env=os.environ | {"OMP_THREAD_LIMIT": "1"})
    except subprocess.TimeoutExpired:
        raise RuntimeError(f"{name}_timeout") from None
    if done.returncode:
        raise RuntimeError(f"{name}_failed")
    return done.stdout


def draw_page(pdf: str, page: int, dpi: int) -> bytes:
    """One page as a grey image; a page that gives no image is a failure."""
    image = _piped(["pdftoppm", "-png", "-gray", "-r", str(dpi), "-f", str(page), "-l", str(page), pdf], DRAW_LIMIT, "pdf_render")
    if not image:
        raise RuntimeError("pdf_render_failed")
    return image


def recognise(image: bytes) -> str:
    return _piped(["tesseract", "stdin", "stdout", *RECOGNISE_OPTIONS], RECOGNISE_LIMIT, "tesseract", image).decode("utf-8", errors="replace")


def has_layout(output: str) -> bool:
    """Whether recognition gave rows with positions rather than plain text."""
    return _NEEDED <= set(output.lstrip("﻿").partition("\n")[0].rstrip("\r").split("\t"))


def page_lines(output: str, page: int) -> tuple[str, list[dict]]:
    """(text, lines) of one page's recognition; every image calls itself page 1, so the true number is put in.

    Rows that do not parse are dropped. Plain text without positions stays as it is, without lines.
    """
    rows = [dict(zip(TSV_COLUMNS, r.split("\t"))) for r in output.lstrip("﻿").splitlines()[1:]] if has_layout(output) else []
    size, words = (None, None), defaultdict(list)
    for place, r in enumerate(rows):
        try:
            level, left, top, width, height = (int(r[k]) for k in ("level", "left", "top", "width", "height"))
            if level == 1:
                size = width, height
            elif level == 5 and r["text"].strip():
                word = {"text": r["text"].strip(), "left": left, "top": top, "width": width, "height": height, "confidence": float(r["conf"])}
                words[tuple(int(r[k]) for k in ("block_num", "par_num", "line_num"))].append((left, place, word))
        except (KeyError, ValueError):
            continue
    found = [[w for _, _, w in sorted(ws, key=lambda x: x[:2])] for ws in words.values()]
    found.sort(key=lambda ws: (min(w["top"] for w in ws), ws[0]["left"]))
    if not found:
        return ("" if has_layout(output) else output), []
    return "\n".join(" ".join(w["text"] for w in ws) for ws in found), [{"page": page, "page_width": size[0], "page_height": size[1], "words": ws} for ws in found]


def raster_reader(draw: Callable[[str, int, int], bytes] = draw_page, read: Callable[[bytes], str] = recognise, pages: Callable[[str], int] = native_page_count) -> Callable[[str, int, int], Reading]:
    """A reader of images for ``reader.routed``: max_pages 0 means all; blank pages keep their place in the text."""

    def one(pdf: str, page: int, dpi: int) -> tuple[str, list[dict]]:
        return page_lines(read(draw(pdf, page, dpi)), page)

    def document(pdf: str, dpi: int, max_pages: int) -> Reading:
        total = pages(pdf)
        todo: Iterator[int] = iter(range(1, (min(total, max_pages) if max_pages > 0 else total) + 1))
        told: list[tuple[str, list[dict]]] = []
        with ThreadPoolExecutor(AT_ONCE) as pool:
            while batch := list(islice(todo, AT_ONCE)):
                told += pool.map(lambda page: one(pdf, page, dpi), batch)
        return Reading("\n".join(t for t, _ in told), [x for _, lines in told for x in lines], "raster", total)

    return document
