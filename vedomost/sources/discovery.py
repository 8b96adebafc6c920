"""Documents and reports found on disk."""

from __future__ import annotations

import json
import os
import stat
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_REPORT_BYTES = 16 * 1024 * 1024


def _failed(error: OSError) -> None:
    raise error


def list_documents(folder: str, suffix: str = ".pdf") -> list[str]:
    """Paths below a folder by case-folded order; links to files and folders are skipped, any error in the walk is raised."""
    found = []
    for base, folders, files in os.walk(folder, onerror=_failed, followlinks=False):
        folders[:] = [d for d in folders if not os.path.islink(os.path.join(base, d))]
        found += [p for f in files if f.lower().endswith(suffix) and not os.path.islink(p := os.path.join(base, f))]
    return sorted(found, key=lambda p: (p.casefold(), p))


def document_paths(spark: SparkSession, folder: str, per_task: int = 64) -> DataFrame:
    """``(seq, pdf, filename)`` of the documents of a local folder; contents are read by the tasks, not here."""
    paths = list_documents(folder)
    rows = [(i, p, Path(p).name) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "seq long, pdf string, filename string")
    return df.repartition(max(1, -(-len(rows) // per_task)), "seq")


def document_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """``(pdf, filename, stem, content, sha256)`` of a distributed folder; names of any case of the suffix."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return raw.select(F.col("path").alias("pdf"), name.alias("filename"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "content", F.sha2("content", 256).alias("sha256"))


def read_report(path: str) -> tuple[dict | None, str | None]:
    """(report, warning): a regular file that did not change between look and open, of bounded size, strict UTF-8, a JSON object.

    No file gives (None, None).
    """
    try:
        before = os.lstat(path)
    except FileNotFoundError:
        return None, None
    except OSError:
        return None, "unreadable"
    if not stat.S_ISREG(before.st_mode):
        return None, "unreadable"
    try:
        handle = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
        with os.fdopen(handle, "rb") as f:
            now = os.fstat(f.fileno())
            if not stat.S_ISREG(now.st_mode) or (now.st_dev, now.st_ino) != (before.st_dev, before.st_ino):
                return None, "unreadable"
            data = f.read(MOST_REPORT_BYTES + 1)
    except OSError:
        return None, "unreadable"
    if len(data) > MOST_REPORT_BYTES:
        return None, "invalid"
    try:
        report = json.loads(data.decode("utf-8"))
    except UnicodeDecodeError:
        return None, "unreadable"
    except ValueError:
        return None, "invalid"
    return (report, None) if isinstance(report, dict) else (None, "invalid")
