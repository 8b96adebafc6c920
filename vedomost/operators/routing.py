"""Which documents are read, read again, and what became of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vedomost.functions.text import document_title, identities

# What names and titles say about a document's kind, and the limits of a second reading.
PERMIT_NAME = r"(?iu)(?<![А-Яа-яЁё])(?:разреш[её]н[А-Яа-яЁё-]*|рнс(?![А-Яа-яЁё]))"
PERMIT_TITLE = r"(?iuU)разрешени\w*\s+на\s+строительств\w*"
OTHER_KIND = r"(?:(?:гро|ро|гпзу)\b|градостроительн\w*\s+план)"
OTHER_NAME = r"(?iuU)^\s*(?:\d+(?:[._-]\d+)*[.)_-]?\s*)?" + OTHER_KIND
OTHER_TITLE = r"(?iuU)^\s*" + OTHER_KIND
RETRY_DPI, RETRY_PAGES = 400, 10
OUTCOMES = ("processed_rns", "unidentified_permit", "out_of_scope", "processing_failed")


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def other_by_name(filename: Column) -> Column:
    return F.translate(stem(filename), "_", " ").rlike(OTHER_NAME)


def permit_like(filename: Column, text: Column, name_ids: Column) -> Column:
    """A permit by its name, a number in its name, or its title; never where the name says otherwise. Body text is no evidence."""
    by_name = stem(filename).rlike(PERMIT_NAME) | (F.size(name_ids) > 0)
    return ~other_by_name(filename) & (by_name | document_title(text).rlike(PERMIT_TITLE))


def other_kind(filename: Column, text: Column) -> Column:
    """A document of another kind by its name or title."""
    return other_by_name(filename) | document_title(text).rlike(OTHER_TITLE)


def classified(documents: DataFrame) -> DataFrame:
    """``documents(filename, text)`` with ``is_permit`` and ``is_other``; NULL text counts as empty."""
    d = documents.withColumn("_ids", identities(stem(F.col("filename"))))
    text = F.coalesce("text", F.lit(""))
    return d.withColumns({"is_permit": permit_like(F.col("filename"), text, F.col("_ids")), "is_other": other_kind(F.col("filename"), text)}).drop("_ids")


def with_outcome(documents: DataFrame) -> DataFrame:
    """``classified`` documents with ``number`` and ``error`` get their ``outcome``; a failed reading is an outcome, not a failed task."""
    return documents.withColumn(
        "outcome",
        F.when(F.col("error").isNotNull(), "processing_failed").when(F.col("number").isNotNull(), "processed_rns").when(F.col("is_permit"), "unidentified_permit").when(F.col("is_other"), "out_of_scope").otherwise("unidentified_permit"),
    )


def retry_page_limit(total_pages: Column, max_pages: int) -> Column:
    asked = max_pages if max_pages > 0 else RETRY_PAGES
    return F.least(F.greatest(total_pages, F.lit(1)), F.lit(asked), F.lit(RETRY_PAGES))


def wants_retry(dpi: int) -> Column:
    """No number found, worth it, and not yet read as an image at full resolution."""
    worth = F.when(F.col("source") == "text_layer", F.col("is_permit") | ~F.col("is_other")).otherwise(F.col("is_permit"))
    return F.col("error").isNull() & F.col("number").isNull() & worth & ~((F.col("source") == "raster") & F.lit(dpi >= RETRY_DPI))


def read_documents(paths: DataFrame, reader: Callable[[DataFrame], DataFrame], identify: Callable[[DataFrame], DataFrame], dpi: int = 180, max_pages: int = 0) -> DataFrame:
    """Documents read once, and the unidentified ones once more.

    ``paths(pdf, filename)``. ``reader`` takes requests (pdf, filename, dpi, max_pages, force_raster) and adds text, lines,
    source, total_pages and error. ``identify`` adds number. Documents whose name alone says another kind never reach the reader: the
    plan is split before it, as a filter behind a Python reader would not spare the reading. The reader's output is
    cut into the shared folder, so no later step reads a document twice. A second reading replaces the first only if it finds a number.
    """
    from vedomost.session import cut_lineage

    named = classified(paths.withColumn("text", F.lit(None).cast("string")))
    skip = named.where("is_other AND NOT is_permit").select("pdf", "filename")
    todo = paths.join(skip.select("pdf").distinct(), "pdf", "left_anti")
    ask = lambda df, d, n, force: df.withColumns({"dpi": d, "max_pages": n, "force_raster": F.lit(force)})
    first = cut_lineage(classified(identify(reader(ask(todo, F.lit(dpi), F.lit(max_pages), False)))))
    again = first.where(wants_retry(dpi)).select("pdf", "filename", "total_pages", "source")
    request = ask(again, F.when(F.col("source") == "raster", RETRY_DPI).otherwise(dpi), retry_page_limit(F.col("total_pages"), max_pages), True).drop("total_pages", "source")
    second = cut_lineage(identify(reader(request)).select("pdf", *[F.col(c).alias(f"_{c}") for c in ("text", "lines", "source", "number", "error")], F.lit(True).alias("retried")))
    j = first.join(second, "pdf", "left")
    better = F.col("_number").isNotNull()
    pick = lambda c: F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    route = F.when(F.col("retried"), joined_route(F.col("source"), F.coalesce("_source", F.lit("failed")))).otherwise(F.col("source"))
    read = j.select("pdf", "filename", pick("text"), pick("lines"), pick("source"), pick("number"), "total_pages", "error", F.col("_error").alias("retry_error"), route.alias("route"), "is_permit", "is_other")
    skipped = skip.select("pdf", "filename", F.lit("preclassified_title").alias("route"), F.lit(False).alias("is_permit"), F.lit(True).alias("is_other"))
    return with_outcome(read.unionByName(skipped, allowMissingColumns=True))


def diagnostics(documents: DataFrame, unlinked: DataFrame) -> DataFrame:
    """``(pdf, filename, outcome, warnings, error)`` of each document, by what weighs most; unlinked amendments without a document are added."""
    u = unlinked.groupBy("pdf").agg(F.first("filename").alias("_f"), F.first("error").alias("_e"))
    retry_error = F.col("retry_error") if "retry_error" in documents.columns else F.lit(None).cast("string")
    j = documents.withColumn("_retry", retry_error).join(u, "pdf", "left")
    linked_no = F.col("_e").isNotNull()
    error = F.coalesce("error", "_retry", "_e", F.when(F.col("outcome") == "unidentified_permit", "Номер РНС не найден."))
    code = F.when(F.col("_retry").isNotNull(), "retry_failed").when(linked_no, "unlinked_directive").when(F.col("outcome") == "out_of_scope", "out_of_scope").when(F.col("outcome") == "unidentified_permit", "number")
    known = j.select("pdf", "filename", "outcome", F.when(code.isNotNull(), F.array(code)).otherwise(F.array().cast("array<string>")).alias("warnings"), F.when(F.col("outcome") != "out_of_scope", error).alias("error"))
    extra = u.join(documents.select("pdf"), "pdf", "left_anti").select("pdf", F.col("_f").alias("filename"), F.lit(None).cast("string").alias("outcome"), F.array(F.lit("unlinked_directive")).alias("warnings"), F.col("_e").alias("error"))
    return known.unionByName(extra)


def normal_trace(trace: Column) -> Column:
    """A read trace with defaults and no negative counts, and its alias fields."""
    whole = lambda c: F.greatest(F.coalesce(c.cast("int"), F.lit(0)), F.lit(0))
    long = lambda c: F.greatest(F.coalesce(c.cast("bigint"), F.lit(0)), F.lit(0))
    times = F.struct(*[long(trace["timings_ms"][s]).alias(s) for s in ("page_count", "text_layer", "render", "tesseract", "total")])
    return F.struct(
        F.lit(1).alias("ocr_trace_version"),
        F.coalesce(trace["route"], F.lit("unknown")).alias("route"),
        *[whole(trace[c]).alias(c) for c in ("requested_dpi", "effective_dpi", "total_pages", "processed_pages", "tesseract_calls")],
        F.coalesce(trace["tesseract_started"], F.lit(False)).alias("tesseract_started"),
        trace["fallback_reason"].alias("fallback_reason"),
        times.alias("timings_ms"),
        whole(trace["effective_dpi"]).alias("dpi"),
        whole(trace["processed_pages"]).alias("pages"),
        whole(trace["tesseract_calls"]).alias("ocr_calls"),
    )


def joined_route(first: Column, second: Column) -> Column:
    """The route of two readings; two of one kind are that kind."""
    return F.when(first == second, first).otherwise(F.concat(first, F.lit("_then_"), second))


def combined_trace(first: Column, second: Column, reason: Column) -> Column:
    """Two readings as one: routes joined, calls and times added, sizes of the second; ``reason`` is why there was a second."""
    a, b = normal_trace(first), normal_trace(second)
    summed = {s: (a["timings_ms"][s] + b["timings_ms"][s]).alias(s) for s in ("page_count", "text_layer", "render", "tesseract", "total")}
    return normal_trace(
        F.struct(
            joined_route(a["route"], b["route"]).alias("route"),
            a["requested_dpi"].alias("requested_dpi"),
            *[b[c].alias(c) for c in ("effective_dpi", "total_pages", "processed_pages")],
            (a["tesseract_calls"] + b["tesseract_calls"]).alias("tesseract_calls"),
            (a["tesseract_started"] | b["tesseract_started"]).alias("tesseract_started"),
            reason.alias("fallback_reason"),
            F.struct(*summed.values()).alias("timings_ms"),
        )
    )


def failure_trace(dpi: int, reason: Column, elapsed_ms: Column) -> Column:
    """The trace of a reading that failed: no progress is claimed, the whole time is."""
    none = {c: F.lit(0).alias(c) for c in ("total_pages", "processed_pages", "tesseract_calls")}
    times = F.struct(*[(elapsed_ms if s == "total" else F.lit(0)).alias(s) for s in ("page_count", "text_layer", "render", "tesseract", "total")])
    sizes = [F.lit(dpi).alias("requested_dpi"), F.lit(dpi).alias("effective_dpi"), *none.values()]
    return normal_trace(F.struct(F.lit("failed").alias("route"), *sizes, F.lit(False).alias("tesseract_started"), reason.alias("fallback_reason"), times.alias("timings_ms")))


def error_hint(error: Column) -> Column:
    """struct(message, hint) for a technical error code."""
    # Codes and what they say.
    known = (("timeout", "Превышено время обработки.", "Повторите с меньшим числом страниц."), ("missing", "Не найден инструмент распознавания.", "Проверьте установку."), ("source_xlsx_changed", "Файл реестра изменился во время работы.", "Закройте реестр и повторите."), ("status_column_occupied", "Столбец статуса занят.", "Освободите столбец."))
    message, hint = F.lit("Внутренняя ошибка обработки."), F.lit("Посмотрите журнал ошибок.")
    for code, m, h in reversed(known):
        message, hint = F.when(F.contains(error, F.lit(code)), m).otherwise(message), F.when(F.contains(error, F.lit(code)), h).otherwise(hint)
    return F.struct(message.alias("message"), hint.alias("hint"))
