"""Merged records against the register: fill what is empty, keep what is there, report what differs.

The register's number cells are read once into identities and aggregated per number before the join, so the
join is one row to one row and an often repeated number costs nothing. The fields of a record are compared as rows of their
own, one CASE for all of them, and grouped back by number without another shuffle; conflicts, writes and checks are
projections of that result, which ``reconcile`` materialises once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vedomost.functions.text import compare_key, identities, merge_status, object_key
from vedomost.operators.merge import day
from vedomost.schemas import DATE_FIELDS, FIRST_ROW, LABELS, TRANSFER_FIELDS

TRANSFER = "Перенести изменения"
STATUS_HEADER = "Статус переноса"
NO_EVIDENCE = "В документе не найдено ни одного подтверждённого поля для переноса."
SEVERAL_ROWS = "Несколько строк Excel содержат этот номер РНС; перенос не выполнен."
NO_ROW = "Изменение/продление содержит номер РНС, но строка Excel не найдена; новая строка не создана."


def register_cells(register: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The register with text cells under the field names; dates as dd.mm.yyyy, '' as NULL.

    ``columns`` maps field names to the register's columns where they differ. Result: row_no, reg_id, number, the
    transfer fields, link, status.
    """
    columns = {"end": "end_date"} | (columns or {})
    kinds = dict(register.dtypes)

    def cell(field: str) -> Column:
        name = columns.get(field, field)
        c = F.date_format(name, "dd.MM.yyyy") if kinds[name] in ("date", "timestamp", "timestamp_ntz") else F.col(name).cast("string")
        return F.nullif(c, F.lit("")).alias(field)

    return register.select("row_no", "reg_id", *[cell(f) for f in ("number", *TRANSFER_FIELDS, "link", "status")])


def register_matches(cells: DataFrame) -> DataFrame:
    """Per number: how many rows hold exactly it, how many hold it among others, and the row if there is one."""
    each = cells.withColumn("ids", identities(F.col("number"))).withColumn("n_ids", F.size("ids"))
    each = each.select(F.explode("ids").alias("id"), "n_ids", F.struct("row_no", "reg_id", "number", *TRANSFER_FIELDS, "link", "status").alias("cells"))
    exact = F.col("n_ids") == 1
    return each.groupBy("id").agg(
        F.count_if(exact).alias("n_exact"),
        F.count_if(~exact).alias("n_ambiguous"),
        F.min(F.when(exact, F.col("cells"))).alias("cells"),
        F.min(F.when(exact, F.col("cells.row_no"))).alias("first_row"),
    )


def _cell_structs() -> Column:
    """The transfer fields of a joined row as an array: place, field, label, register value, document value, quality."""

    def proposed(f: str) -> Column:
        return F.date_format(day(F.col(f)), "dd.MM.yyyy") if f in DATE_FIELDS else F.col(f)

    def cell(i: int, f: str) -> Column:
        return F.struct(
            F.lit(i).alias("place"),
            F.lit(f).alias("field"),
            F.lit(LABELS[f]).alias("label"),
            F.when(F.col("row_no").isNotNull(), F.col(f"cells.{f}")).alias("existing"),
            proposed(f).alias("proposed"),
            F.col("field_quality")[f]["status"].alias("quality"),
        )

    return F.array(*[cell(i, f) for i, f in enumerate(TRANSFER_FIELDS)])


def compared_cells(joined: DataFrame) -> DataFrame:
    """One row per record and transfer field, with what happens to the field and why.

    ``joined``: number, row_no, cells, the fields and field_quality. Result: number, head, place, field, existing, proposed,
    quality, action, issue. Each comparison key is computed once, in a row of its own; ``joined`` lies by number already, so neither
    the rows nor the grouping back need a shuffle.
    """
    long = joined.select("number", "head", F.inline(_cell_structs()))

    def key(side: str) -> Column:
        text = F.col(side)
        return F.when(F.col("field").isin(*DATE_FIELDS), text).otherwise(F.when(F.col("field") == "object", object_key(text)).otherwise(compare_key(text)))

    both = F.col("existing").isNotNull() & F.col("proposed").isNotNull()
    long = long.withColumn("differs", F.when(both, key("existing") != key("proposed")))
    weak, empty = F.coalesce(F.col("quality") != "actionable", F.lit(False)), F.col("existing").isNull()
    action = (
        F.when(F.col("proposed").isNull(), "skip")
        .when(weak, F.when(empty, "weak").when(F.col("differs"), "weak_conflict").otherwise("equal"))
        .when(empty, "write")
        .when(F.col("differs"), "conflict")
        .otherwise("equal")
    )
    long = long.withColumns({"existing": F.trim("existing"), "action": action})
    different = F.concat(F.lit("Не перенесено «"), "label", F.lit("»: в Excel — «"), "existing", F.lit("», в PDF — «"), "proposed", F.lit("»; значение Excel сохранено."))
    unproven = F.concat(F.lit("Не перенесено «"), "label", F.lit("»: значение PDF требует ручной сверки."))
    issue = F.when(F.col("action").isin("weak", "weak_conflict"), unproven).when(F.col("action") == "conflict", different)
    return long.select("number", "head", "place", "field", "existing", "proposed", "quality", "action", issue.alias("issue"))


def planned_changes(merged: DataFrame, register: DataFrame) -> DataFrame:
    """One row per merged record with its outcome.

    Outcomes: ``review_conflict`` (several rows, a cell with several numbers, or amendments without a row), ``review``,
    ``added``, ``updated``, ``already_present``. Result: number, row_no, new, outcome, fields (array of place, field, existing,
    proposed, quality, action, issue), written, issues, status, old_status, link, filename, pdf, end, object, merge_issues, existing_only,
    field_sources, n_exact, n_matches, physical_mutation. ``register`` comes from ``register_cells``; an empty one makes every record new.
    ``merged`` has one row per number; a NULL number matches nothing. New rows have no row_no yet (see ``assign_rows``).
    This is the lazy plan, for a single use; ``reconcile`` materialises it.
    """
    found = register_matches(register)
    j = merged.join(found, merged["number"] == found["id"], "left")
    n_exact, n_amb = F.coalesce("n_exact", F.lit(0)).cast("long"), F.coalesce("n_ambiguous", F.lit(0)).cast("long")
    j = j.withColumn("row_no", F.when((n_exact == 1) & (n_amb == 0), F.col("cells.row_no")))
    carried = ["row_no", "filename", "pdf", "end", "object", "merge_issues", "existing_only", "field_sources"]
    old = F.when(F.col("row_no").isNotNull(), F.col("cells.status")).alias("old_status")
    old_link = F.when(F.col("row_no").isNotNull(), F.col("cells.link")).alias("old_link")
    j = j.withColumn("head", F.struct(*carried, n_exact.alias("n_exact"), n_amb.alias("n_ambiguous"), old, old_link))
    entry = F.struct("place", "field", "existing", "proposed", "quality", "action", "issue")
    g = compared_cells(j).groupBy("number").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(entry)).alias("fields"))  # ten entries each
    g = g.select("number", "head.*", "fields")
    several = (F.col("n_exact") > 1) | (F.col("n_ambiguous") > 0)
    no_row = ~several & F.coalesce("existing_only", F.lit(False)) & (F.col("n_exact") == 0)
    state = (
        F.when(several, "several").when(no_row, "no_row").when(~F.exists("fields", lambda x: x.proposed.isNotNull()), "bare").otherwise("compared")
    )
    g = g.withColumn("state", state)
    compared = F.col("state") == "compared"
    g = g.withColumns({"new": compared & F.col("row_no").isNull(), "fields": F.when(compared, F.col("fields")), "said": F.transform("merge_issues", lambda i: i.message)})
    told = F.filter(F.transform("fields", lambda x: x.issue), lambda x: x.isNotNull())
    issues = (
        F.when(F.col("state") == "several", F.array(F.lit(SEVERAL_ROWS)))
        .when(F.col("state") == "no_row", F.array(F.lit(NO_ROW)))
        .when(F.col("state") == "bare", F.when(F.size("said") > 0, F.col("said")).otherwise(F.array(F.lit(NO_EVIDENCE))))
        .otherwise(F.concat("said", told))
    )
    names = F.coalesce(F.transform(F.filter("fields", lambda x: x.action == "write"), lambda x: x.field), F.array().cast("array<string>"))
    g = g.withColumns({"issues": issues, "written": F.when(F.col("new"), F.concat(F.array(F.lit("number")), names)).otherwise(names)})
    outcome = (
        F.when(F.col("state").isin("several", "no_row"), "review_conflict")
        .when((F.col("state") == "bare") | (F.size("issues") > 0), "review")
        .when(F.col("new"), "added")
        .when(F.size("written") > 0, "updated")
        .otherwise("already_present")
    )
    g = g.withColumn("outcome", outcome)
    touched = (F.col("outcome") != "review_conflict") & (F.col("row_no").isNotNull() | F.col("new"))
    status = F.when(touched, F.when(F.col("outcome") == "already_present", F.col("old_status")).otherwise(merge_status(F.col("old_status"), F.col("issues"))))
    linked = F.col("outcome").isin("review", "added", "updated") & (F.size("written") > 0)
    g = g.withColumns({"status": status, "link": F.when(linked, F.col("filename"))})
    mutation = (F.size("written") > 0) | (touched & ~F.col("status").eqNullSafe(F.col("old_status")))
    kept = ["number", "row_no", "new", "outcome", "fields", "written", "issues", "status", "old_status", "link", "old_link", *carried[1:], "n_exact"]
    return g.select(*kept, (F.col("n_exact") + F.col("n_ambiguous")).alias("n_matches"), mutation.alias("physical_mutation"))


def reconcile(merged: DataFrame, register: DataFrame) -> DataFrame:
    """``planned_changes`` written to the shared folder once, for conflicts, the register, checks and proposals to read."""
    from vedomost.session import cut_lineage

    return cut_lineage(planned_changes(merged, register))


def conflicts(changes: DataFrame) -> DataFrame:
    """One row per difference left to an operator: ``(number, row_no, field, existing, proposed, action, quality)``.

    One pass: a blocked record gives one row for its number, a compared one a row per differing field.
    """
    whole = F.struct(
        F.lit("number").alias("field"),
        F.when(F.col("n_exact") > 1, "несколько строк Excel").when(F.col("n_matches") > 0, "несколько номеров РНС в ячейке Excel").otherwise("строка Excel не найдена").alias("existing"),
        F.col("number").alias("proposed"),
        F.lit("review_conflict").alias("action"),
        F.lit(None).cast("string").alias("quality"),
    )
    differing = F.filter("fields", lambda x: x.action.isin("conflict", "weak_conflict"))
    cells = F.transform(differing, lambda x: F.struct(x.field.alias("field"), x.existing.alias("existing"), x.proposed.alias("proposed"), F.lit(TRANSFER).alias("action"), x.quality.alias("quality")))
    return changes.select("number", "row_no", F.inline(F.when(F.col("outcome") == "review_conflict", F.array(whole)).otherwise(cells)))


def status_column(header: str | None) -> bool:
    """Whether the status column's header has to be written; raises where the column belongs to something else.

    Writing it is a change of the register, so a first run publishes even if every row is already present.
    """
    if header in (None, ""):
        return True
    if header != STATUS_HEADER:
        raise RuntimeError("status_column_occupied")
    return False


def assign_rows(changes: DataFrame, register: DataFrame) -> DataFrame:
    """``(number, row_no, reg_id)`` of the new rows, in the order of their numbers, behind the last used row.

    The places come from per-partition counts of a range-sorted table, so no single task numbers all rows.
    """
    used = F.coalesce(*[F.col(f) for f in ("number", *TRANSFER_FIELDS, "link")]).isNotNull() | F.col("reg_id").isNotNull()
    last = register.agg(F.coalesce(F.max(F.when(used, F.col("row_no"))), F.lit(FIRST_ROW - 1)).alias("last_row"), F.coalesce(F.max("reg_id"), F.lit(0)).alias("last_id"))
    numbered = rank_rows(changes.where("new").select("number"), "number").withColumn("_one", F.lit(1))
    j = numbered.join(F.broadcast(last.withColumn("_one", F.lit(1))), "_one")  # one row
    return j.select("number", (F.col("place") + F.col("last_row")).cast("int").alias("row_no"), (F.col("place") + F.col("last_id")).cast("long").alias("reg_id"))


def rank_rows(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``place`` 1, 2, ... in ascending order of a column."""
    from vedomost.session import cut_lineage

    parts = cut_lineage(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n"), F.min(order).alias("first"))  # one row per partition
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "before")
    local = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    return local.join(F.broadcast(offsets), "_p").withColumn("place", F.col("before") + F.col("_k")).drop("_p", "_k", "before")


def written_value(field: str) -> Column:
    """What a change writes into a field; NULL if it writes nothing there."""
    return F.try_element_at(F.filter("fields", lambda x: (x.field == field) & (x.action == "write")), F.lit(1))["proposed"]


def apply_changes(register: DataFrame, changes: DataFrame) -> DataFrame:
    """The register after the run: empty cells filled, statuses and links set, new rows appended."""
    update = changes.where("row_no IS NOT NULL AND outcome <> 'review_conflict'")
    writes = update.select("row_no", F.col("status").alias("_status"), F.col("link").alias("_link"), *[written_value(f).alias(f"_{f}") for f in TRANSFER_FIELDS], F.lit(True).alias("_hit"))
    kept = register.join(writes, "row_no", "left")
    kept = kept.select("row_no", "reg_id", "number", *[F.coalesce(f, f"_{f}").alias(f) for f in TRANSFER_FIELDS], F.coalesce("_link", "link").alias("link"), F.when(F.col("_hit"), F.col("_status")).otherwise(F.col("status")).alias("status"))
    rows = assign_rows(changes, register).withColumnRenamed("row_no", "_row")
    fresh = changes.where("new").join(rows, "number")
    added = fresh.select(F.col("_row").alias("row_no"), "reg_id", "number", *[written_value(f).alias(f) for f in TRANSFER_FIELDS], "link", "status")
    return kept.unionByName(added)


def cell_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells that differ between two registers: ``(row_no, field, before, after)``; NULL and missing rows count as empty cells."""
    fields = ("number", *TRANSFER_FIELDS, "link", "status")

    def cells(df: DataFrame, side: str) -> DataFrame:
        return df.select("row_no", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(side)) for f in fields])).alias("c")).select("row_no", "c.field", f"c.{side}")

    both = cells(before, "before").unionByName(cells(after, "after"), allowMissingColumns=True)
    seen = both.groupBy("row_no", "field").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    return seen.where(~F.col("before").eqNullSafe(F.col("after")))


def check_publication(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """Violations of what a run promises, none if it kept them: ``(rule, row_no, field)``.

    A filled cell other than status and link never changes; rows already present never change; no row is lost.
    """
    diff = cell_diff(before, after)
    present = changes.where("outcome = 'already_present'").select("row_no").distinct()
    overwritten = diff.where("before IS NOT NULL AND field NOT IN ('status', 'link')").select(F.lit("filled_cell_changed").alias("rule"), "row_no", "field")
    touched = diff.join(present, "row_no", "left_semi").select(F.lit("present_row_changed").alias("rule"), "row_no", "field")
    lost = before.join(after.select("row_no"), "row_no", "left_anti").select(F.lit("row_lost").alias("rule"), "row_no", F.lit(None).cast("string").alias("field"))
    return overwritten.unionByName(touched).unionByName(lost)


def _overwritten(register: DataFrame, cells: DataFrame, extra: list[Column], marker: Column | None) -> DataFrame:
    """The register with single cells replaced and those fields' generated status lines taken out; ``marker`` ends the status."""
    order = F.col("seq") if "seq" in cells.columns else F.lit(0)
    last = cells.groupBy("row_no", "field").agg(F.max(F.struct(order.alias("s"), "value", *extra)).alias("v"))
    labels = F.create_map(*[F.lit(x) for f in TRANSFER_FIELDS for x in (f, LABELS[f])])
    per_row = last.where(F.col("field").isin(*TRANSFER_FIELDS)).groupBy("row_no").agg(
        F.array_sort(F.collect_list(F.struct(labels[F.col("field")].alias("label"), "field", "v"))).alias("_cells")  # ten fields at most
    )
    j = register.join(per_row, "row_no", "left").withColumn("_by_field", F.map_from_entries(F.transform("_cells", lambda c: F.struct(c.field, c.v))))
    stale = F.transform("_cells", lambda c: F.concat(F.lit("Не перенесено «"), c.label, F.lit("»:")))
    kept = F.filter(F.split("status", "\n"), lambda line: ~F.exists(stale, lambda m: F.startswith(line, m)))
    lines = kept if marker is None else F.concat(F.coalesce(kept, F.array().cast("array<string>")), F.array(marker))
    fields = [F.when(F.map_contains_key("_by_field", F.lit(f)), F.col("_by_field")[f]["value"]).otherwise(F.col(f)).alias(f) for f in TRANSFER_FIELDS]
    touched = F.col("_cells").isNotNull()
    link = F.coalesce(F.array_max(F.transform("_cells", lambda c: c.v["filename"])), F.col("link")) if extra else F.col("link")
    return j.select("row_no", "reg_id", "number", *fields, link.alias("link"), F.when(touched, F.nullif(F.array_join(lines, "\n"), F.lit(""))).otherwise(F.col("status")).alias("status"))


def approve_values(register: DataFrame, approvals: DataFrame) -> DataFrame:
    """Single approved values written over register cells; ``approvals(row_no, field, value)``, the last per cell by ``seq`` if given.

    The field's generated status line goes, the rest of the status stays. With ``filename`` in the approvals the row's link
    becomes the document the value comes from. Rows and fields that do not exist change nothing.
    """
    return _overwritten(register, approvals, [F.col("filename")] if "filename" in approvals.columns else [], None)


def edit_values(register: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual corrections of register cells; ``edits(row_no, field, value)`` as ``text.edit_value`` leaves them, NULL clears.

    The row keeps its link; its status loses the fields' generated lines and ends with a line that names what was corrected.
    """
    named = F.array_join(F.transform("_cells", lambda c: F.concat(F.lit("«"), c.label, F.lit("»"))), ", ")
    return _overwritten(register, edits, [], F.concat(F.lit("Исправлено вручную: "), named, F.lit(".")))
