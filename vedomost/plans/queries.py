"""The core queries, by name; each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vedomost.functions import redact, text, values
from vedomost.operators import copydiff, extract, history, layout, merge, reconcile, routing, summary
from vedomost.schemas import CONSENSUS_FIELDS, EVIDENCE_FIELDS, TRANSFER_FIELDS
from vedomost.session import table

FLAGSHIP = "reconcile_outcomes"


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rns_records").withColumnRenamed("end_date", "end")


def register(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.register_cells(table(spark, d, "register_rows"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.planned_changes(merge.merge_versions(records(spark, d)), register(spark, d))


def settled(spark: SparkSession, d: str) -> DataFrame:
    """``changes`` materialised once, for queries that use them several times."""
    return reconcile.reconcile(merge.merge_versions(records(spark, d)), register(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copydiff.register_copy_diff(table(spark, d, "register_rows"), table(spark, d, "register_copy"))


def compare_keys(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("rec_id", *[text.field_key(f, F.col(f)).alias(f"{f}_key") for f in ("issuer", "builder", "developer", "object")])
    return r.distinct()


def register_identities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "register_rows").select("row_no", F.array_join(text.identities(F.col("number")), ",").alias("ids"))


def merge_select_base(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_bases(records(spark, d))


def merge_latest_date(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_versions(records(spark, d)).select("number", F.col("end").alias("end_date"), "changed", "filename")


def merge_consensus(spark: SparkSession, d: str) -> DataFrame:
    m = merge.merge_versions(records(spark, d))
    return m.select("number", *CONSENSUS_FIELDS, F.array_join(F.array_sort(F.transform("merge_issues", lambda i: i.code)), ",").alias("issues"))


def merge_warnings(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_versions(records(spark, d)).select("number", F.array_join(F.array_sort("warnings"), ",").alias("warnings"), "existing_only")


def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_sources(records(spark, d))


def unlinked_directives(spark: SparkSession, d: str) -> DataFrame:
    return merge.unlinked_directives(records(spark, d)).select("number", "filename", "error")


def reconcile_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return changes(spark, d).select("number", "row_no", "new", "outcome", F.size("issues").cast("long").alias("n_issues"), F.size("written").cast("long").alias("n_written"))


def reconcile_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.conflicts(changes(spark, d)).select("number", "row_no", "field", "existing", "proposed", "action")


def reconcile_register(spark: SparkSession, d: str) -> DataFrame:
    reg = register(spark, d)
    after = reconcile.apply_changes(reg, settled(spark, d))
    return after.select("row_no", "reg_id", "number", *[F.col(f).alias(f"{f}_") if f == "end" else F.col(f) for f in TRANSFER_FIELDS])


def new_row_ids(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.assign_rows(settled(spark, d), register(spark, d))


def cell_diff(spark: SparkSession, d: str) -> DataFrame:
    reg = register(spark, d)
    diff = reconcile.cell_diff(reg, reconcile.apply_changes(reg, settled(spark, d)))
    return diff.where("field NOT IN ('status', 'link')").groupBy("field").agg(F.count("*").alias("n_changed"), F.count("before").alias("n_overwritten"))


def publication_check(spark: SparkSession, d: str) -> DataFrame:
    reg, ch = register(spark, d), settled(spark, d)
    return reconcile.check_publication(reg, reconcile.apply_changes(reg, ch), ch)


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.run_summary(changes(spark, d))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the records, an id for each."""
    return records(spark, d).select("pdf", F.sha2("pdf", 256).alias("document_id")).distinct()


def proposals(spark: SparkSession, d: str) -> DataFrame:
    p = summary.proposals(settled(spark, d), _documents(spark, d))
    return p.select("number", "row_no", "field", "existing", "proposed", "status", "filename")


def review_rows(spark: SparkSession, d: str) -> DataFrame:
    ch = settled(spark, d)
    return summary.unresolved_rows(summary.row_cards(ch), summary.proposals(ch, _documents(spark, d)))


def row_cards(spark: SparkSession, d: str) -> DataFrame:
    return summary.row_cards(changes(spark, d)).select("number", "row_no", "outcome", "needs_review", "editable", "filename")


def display_partition(spark: SparkSession, d: str) -> DataFrame:
    ch = settled(spark, d)
    none = spark.createDataFrame([], "document_id string, outcome string")
    return summary.display_partition(summary.row_cards(ch), summary.proposals(ch, _documents(spark, d)), none).groupBy("place").agg(F.count("*").alias("n"))


def doc_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.document_title(F.col("text")).alias("title"))


def doc_classify(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("filename", F.lit("")).alias("filename"), "text")
    read = extract.with_identity(docs.withColumn("lines", F.lit(None).cast(f"array<{layout.LINE}>")).withColumn("text", F.coalesce("text", F.lit(""))))
    return routing.with_outcome(routing.classified(read).withColumn("error", F.lit(None).cast("string"))).select("doc_id", "outcome", "is_permit", "is_other")


def extract_records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/"), F.coalesce("filename", F.lit("x.pdf"))).alias("pdf"), F.coalesce("filename", F.lit("x.pdf")).alias("filename"), "text")
    r = extract.extract_records(docs)
    return r.select("doc_id", "number", *[F.col(f).alias(f"{f}_") if f == "end" else F.col(f) for f in EVIDENCE_FIELDS], "number_source", F.array_join("warnings", ",").alias("warnings"))


def document_dates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", values.valid_days(values.days_in(F.coalesce("text", F.lit("")))).alias("v"))
    return docs.select("doc_id", F.size("v.valid").cast("long").alias("n_valid"), F.coalesce("v.any_invalid", F.lit(False)).alias("any_invalid"), values.latest_day(F.col("v.valid")).alias("latest"))


def add_months(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("rec_id", values.add_months(F.col("issue"), F.lit(13)).alias("later")).where("later IS NOT NULL").distinct()


def clean_fields(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("rec_id", text.clean_field(F.col("builder")).alias("builder"), text.clean_district(F.col("district")).alias("district")).distinct()


def field_quality(spark: SparkSession, d: str) -> DataFrame:
    q = records(spark, d).select(F.explode("field_quality").alias("field", "q"))
    return q.groupBy("field", "q.status", "q.reason").agg(F.count("*").alias("n"), F.round(F.min("q.confidence"), 1).alias("least"))


def redact_paths(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("rec_id", "pdf", F.concat(F.lit("cannot open '"), "pdf", F.lit("', skipped")).alias("error"))
    return r.select("rec_id", redact.redact_value(F.col("pdf")).alias("pdf"), redact.redact_value(F.col("error"), True).alias("error")).distinct()


def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    zero = F.lit(0)
    t = e.select(F.col("event_type").alias("route"), (F.col("event_type") == "error").alias("failed"), F.lit(1).alias("total_pages"), F.lit(1).alias("processed_pages"), zero.alias("tesseract_calls"), zero.alias("ocr_calls"), F.floor("value").alias("page_count"), zero.alias("text_layer"), zero.alias("render"), zero.alias("tesseract"), F.floor("value").alias("total"))
    s = summary.trace_summary(t)
    return s.select("documents", "failed", F.array_join(F.transform(F.map_entries("routes"), lambda x: F.concat_ws("=", x.key, x.value.cast("string"))), ",").alias("routes"), "total_pages", F.col("total").alias("total_ms"))


def history_validate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return history.validate_item_groups(e, "user_id", (F.col("k") >= 4) & (F.col("value") >= 0))


def progress_running_max(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return summary.running_max(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", "progress")


def _scan_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_lines").where("line_no > 0").withColumnRenamed("scan_id", "doc_id").dropDuplicates(["line_id"])


def line_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = _scan_lines(spark, d).select("line_id", layout.line_gap(F.col("words"), F.col("page_width")).alias("g")).where("g IS NOT NULL")
    return g.select("line_id", "g.gap", "g.mid")


def page_boundary(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_boundaries(_scan_lines(spark, d))


def layout_text(spark: SparkSession, d: str) -> DataFrame:
    return _scan_lines(spark, d).select("line_id", layout.line_text(F.col("words")).alias("line"))


def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return layout.document_text(_scan_lines(spark, d)).select("doc_id", F.length("text").alias("n_chars"), F.size("lines").alias("n_lines"))


def scan_records(spark: SparkSession, d: str) -> DataFrame:
    docs = layout.document_text(_scan_lines(spark, d)).select("doc_id", F.concat(F.lit("/scans/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("pdf"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "text", "lines", F.lit("raster").alias("source"))
    r = extract.extract_records(docs)
    return r.select("doc_id", "number", "issue", "changed", "builder", F.size("field_quality").alias("n_judged"))


def order_status(spark: SparkSession, d: str) -> DataFrame:
    """The status texts after the run, generated lines replaced and notes kept."""
    return changes(spark, d).where("row_no IS NOT NULL").select("row_no", "status")


_HELPERS = {"records", "register", "changes", "settled"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in _HELPERS | {"queries"}}
