"""Run summaries, proposals, row cards and the partition of cards for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vedomost.operators.reconcile import TRANSFER, conflicts
from vedomost.schemas import FIRST_ROW

OUTCOMES = ("processed_rns", "out_of_scope", "unidentified_permit", "processing_failed")
TIMINGS = ("page_count", "text_layer", "render", "tesseract", "total")


def trace_summary(traces: DataFrame) -> DataFrame:
    """One row over ``traces(route, failed, total_pages, processed_pages, tesseract_calls, ocr_calls, page_count, text_layer, render, tesseract, total)``.

    Routes come as a sorted map of counts. NULL counters count as 0; an empty table gives zeros.
    """
    counters = ("total_pages", "processed_pages", "tesseract_calls", "ocr_calls")
    per_route = traces.groupBy(F.coalesce("route", F.lit("unknown")).alias("route")).agg(
        F.count("*").alias("n"), F.count_if(F.col("failed")).alias("n_failed"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (*counters, *TIMINGS)]
    )
    total = per_route.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("documents"),
        F.coalesce(F.sum("n_failed"), F.lit(0)).cast("long").alias("failed"),
        F.array_sort(F.collect_list(F.struct("route", "n"))).alias("routes"),  # one entry per route
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (*counters, *TIMINGS)],
    )
    return total.withColumn("routes", F.map_from_entries("routes"))


def run_summary(changes: DataFrame, documents: DataFrame | None = None, published: bool = True) -> DataFrame:
    """One row of counts over the changes, and over ``documents(outcome)`` where given.

    Rows under review count once each, by row, else by number; a run without publication changed no row.
    """
    review = F.col("outcome").isin("review", "review_conflict")
    key = F.coalesce(F.col("row_no").cast("string"), F.concat(F.lit("#"), F.col("number")))
    n_conflicts = F.when(F.col("outcome") == "review_conflict", 1).otherwise(F.coalesce(F.size(F.filter("fields", lambda x: x.action.isin("conflict", "weak_conflict"))), F.lit(0)))
    n_conflicts = F.greatest(n_conflicts, F.lit(0))
    out = changes.agg(
        F.count("*").alias("record_count"),
        (F.count_if(F.col("physical_mutation")) if published else F.lit(0)).cast("long").alias("changed_rows"),
        F.count_distinct(F.when(review, key)).alias("review_rows"),
        F.count_if(F.col("new")).alias("new_rows"),
        F.count_if(F.col("outcome") == "already_present").alias("already_present_count"),
        F.coalesce(F.sum(n_conflicts), F.lit(0)).cast("long").alias("conflicts"),
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).cast("long").alias("issue_count"),
    )
    if documents is None:
        return out
    counts = documents.agg(
        F.count_if(~F.col("outcome").isin("unidentified_permit", "processing_failed")).alias("pdf_count"),
        F.count_if(F.col("outcome").isin("unidentified_permit", "processing_failed")).alias("failed_pdf_count"),
        *[F.count_if(F.col("outcome") == o).alias(f"{o}_count") for o in OUTCOMES],
    )
    return out.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")


def summary_rows(changes: DataFrame) -> DataFrame:
    """The rows behind the summary's lists: ``(list, row_no, filename)``, one row per entry, so long lists stay distributed."""
    lists = F.array(
        F.when(F.col("outcome") == "already_present", "already_present_rows"),
        F.when(F.size("issues") > 0, "rows_with_issues"),
        F.lit("row_numbers"),
        F.when(F.col("new"), "new_row_numbers"),
    )
    return changes.where("row_no IS NOT NULL").select(F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("list"), "row_no", "filename")


def proposals(changes: DataFrame, documents: DataFrame) -> DataFrame:
    """Differences an operator may transfer: one row per conflict whose source document is known.

    ``documents(pdf, document_id)``. Conflicts without a document are left out here (and still counted in the summary).
    Weak values are for review only and get no id. Ids are digests of number and field: equal runs give equal ids.
    """
    c = conflicts(changes).where(F.col("action") == TRANSFER)
    source = changes.select("number", "object", "merge_issues", F.col("field_sources").alias("sources"))
    j = c.join(source, "number").withColumn("pdf", F.col("sources")[F.col("field")])
    j = j.join(documents.select("pdf", "document_id").dropDuplicates(["pdf"]), "pdf")
    weak = F.col("quality").isNotNull() & (F.col("quality") != "actionable")
    details = F.nullif(F.array_join(F.transform("merge_issues", lambda i: i.message), "; "), F.lit(""))
    return j.select(
        F.when(~weak, F.substring(F.sha2(F.concat_ws("\u0000", "number", "field"), 256), 1, 32)).alias("id"),
        "number",
        "row_no",
        "field",
        "existing",
        "proposed",
        "object",
        F.when(weak, "review").otherwise("pending").alias("status"),
        details.alias("review_details"),
        "document_id",
        F.regexp_extract("pdf", r"([^/\\]+)$", 1).alias("filename"),
    )


def row_cards(changes: DataFrame) -> DataFrame:
    """One card per change: ``(number, row_no, object, details, outcome, needs_review, editable, filename)``."""
    review = F.col("outcome").isin("review", "review_conflict")
    return changes.select(
        "number",
        "row_no",
        "object",
        F.nullif(F.array_join("issues", "; "), F.lit("")).alias("details"),
        "outcome",
        review.alias("needs_review"),
        (F.coalesce(F.col("row_no") >= FIRST_ROW, F.lit(False)) & (F.col("new") | review)).alias("editable"),
        F.regexp_extract("filename", r"([^/\\]+)$", 1).alias("filename"),
    )


def unresolved_rows(cards: DataFrame, props: DataFrame) -> DataFrame:
    """The distinct rows that still need a decision: ``(key)``.

    A card under review is settled only if it has proposals, all of them approved or edited and none with details.
    """
    open_ = F.col("review_details").isNotNull() | ~F.col("status").isin("approved", "resolved_manual")
    related = props.where("row_no IS NOT NULL").groupBy("row_no").agg(F.bool_or(open_).alias("open"))
    j = cards.where("needs_review").join(related, "row_no", "left").where(F.coalesce("open", F.lit(True)))
    return j.select(F.coalesce(F.col("row_no").cast("string"), F.concat(F.lit("#"), F.col("number"))).alias("key")).distinct()


def display_partition(cards: DataFrame, props: DataFrame, documents: DataFrame) -> DataFrame:
    """Every card and document in exactly one of five places: ``(place, key)``.

    Cards with open proposals or under review, cards that matched, cards all of whose proposals are approved, the rest
    processed, and documents with a problem.
    """
    p = props.groupBy("number").agg(F.bool_and(F.col("status").isin("approved", "resolved_manual")).alias("settled"))
    j = cards.join(p, "number", "left")
    place = (
        F.when(F.coalesce("settled", F.lit(False)), "approved")
        .when(F.col("needs_review") | F.col("settled").isNotNull(), "review")
        .when(F.col("outcome") == "already_present", "matched")
        .otherwise("processed")
    )
    issues = documents.where(F.col("outcome").isin("unidentified_permit", "processing_failed"))
    return j.select(place.alias("place"), F.col("number").alias("key")).unionByName(issues.select(F.lit("document_issue").alias("place"), F.col("document_id").alias("key")))


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``progress``, the greatest value so far within its keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("progress", F.max(value).over(w))


def keep_last(jobs: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` finished jobs by ``finished_at`` and every job that is not finished or has an action in flight."""
    done = F.coalesce(F.col("status").isin("done", "error") & ~F.coalesce("in_flight", F.lit(False)), F.lit(False))
    return jobs.where(~done).unionByName(jobs.where(done).orderBy(F.col("finished_at").desc(), F.col("job_id").desc()).limit(n))


def failure_message(failures: Column, shown: int = 3) -> Column:
    """The first failures and how many more there are."""
    head = F.array_join(F.slice(failures, 1, shown), "; ")
    return F.when(F.size(failures) > shown, F.concat(head, F.lit("; ещё "), (F.size(failures) - shown).cast("string"))).otherwise(head)
