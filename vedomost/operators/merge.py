"""Versions of one permit folded into one record.

One grouping by permit number with aggregates that combine before the shuffle (``max_by`` on structs,
``min``/``max`` of comparison keys): no list of a permit's versions is ever held, so one permit may own a third of all rows.
The latest dated directive overall is the latest among those newer than the base, if it is newer at all, and a
field is unanimous exactly if the least and the greatest comparison key agree; both spare a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vedomost.functions.text import field_key
from vedomost.schemas import AMENDMENT_MARKS, CONSENSUS_FIELDS, DATE_FIELDS, EVIDENCE_FIELDS, ISSUE, LABELS, LATEST_FIELDS


def day(c: Column) -> Column:
    """A strict dd.mm.yyyy date; NULL for anything else and for days that do not exist."""
    return F.when(c.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.regexp_replace(c, r"^(\d+)\.(\d+)\.(\d+)$", "$3-$2-$1").try_cast("date"))


def is_amendment(filename: Column) -> Column:
    """Whether a file name marks a change, prolongation or order."""
    return F.lower(F.coalesce(filename, F.lit(""))).rlike("|".join(AMENDMENT_MARKS))


def evidence_count(columns: dict[str, Column]) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns.values()), F.lit(0))


def _prepared(records: DataFrame) -> DataFrame:
    text = {f: F.col(f).cast("string") for f in EVIDENCE_FIELDS}
    return records.select(
        "number",
        "pdf",
        "filename",
        *[c.alias(f) for f, c in text.items()],
        F.coalesce("field_provenance", F.create_map().cast("map<string,string>")).alias("field_provenance"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        "field_quality",
        evidence_count(text).alias("n_evidence"),
        is_amendment(F.col("filename")).alias("amendment"),
    )


def _keyed(p: DataFrame) -> DataFrame:
    """Comparison keys of what amendments offer, as columns: the JVM call in them may not stand inside an aggregate."""
    keys = {f: F.date_format(day(F.col(f)), "yyyy-MM-dd") if f == "issue" else field_key(f, F.col(f)) for f in CONSENSUS_FIELDS}
    return p.withColumns({f"key_{f}": F.when(F.col("amendment") & (F.col("n_evidence") > 0) & F.col(f).isNotNull(), k) for f, k in keys.items()})


def merge_versions(records: DataFrame) -> DataFrame:
    """One row per number from all its versions.

    ``records``: number, the ten evidence fields, pdf, filename, field_provenance, warnings, field_quality. The base is the
    fullest version that is no amendment (then latest ``changed``, file name, path); amendments fill its gaps where they
    agree, and replace ``end`` and ``changed`` by strictly later days. A permit of amendments only starts
    empty and is marked ``existing_only``. Amendments without any evidence are left out (``unlinked_directives``). The
    result does not depend on the order of rows; repeated rows change nothing. NULL numbers form one group; an empty
    table gives no row.
    """
    p = _keyed(_prepared(records))
    floor_day = F.lit("0001-01-01").cast("date")
    amend, linked = F.col("amendment"), F.col("amendment") & (F.col("n_evidence") > 0)
    row = F.struct(*EVIDENCE_FIELDS, "pdf", "filename", "field_provenance", "warnings", "field_quality")
    rank = F.struct("n_evidence", F.coalesce(day(F.col("changed")), floor_day).alias("d"), F.coalesce("filename", F.lit("")).alias("f"), F.coalesce("pdf", F.lit("")).alias("p"))
    name = F.struct(F.coalesce("filename", F.lit("")).alias("f"), F.coalesce("pdf", F.lit("")).alias("p"))

    def offer(f: str) -> Column:
        return F.struct(F.col(f).alias("value"), F.col("pdf").alias("pdf"), F.col("filename").alias("filename"), F.coalesce(F.col("field_provenance")[f], F.lit("ocr")).alias("provenance"), F.col("field_quality")[f].alias("quality"))

    aggs = [
        F.max_by(row, F.when(~amend, rank)).alias("base_permit"),
        F.max_by(row, F.when(amend, rank)).alias("base_directive"),
        F.count_if(~amend).alias("n_permits"),
        F.count("*").alias("n_versions"),
        F.count_if(linked).alias("n_linked"),
    ]
    for f in LATEST_FIELDS:
        dated = linked & day(F.col(f)).isNotNull()
        aggs.append(F.max_by(offer(f), F.when(dated, F.struct(day(F.col(f)).alias("d"), name.alias("n")))).alias(f"latest_{f}"))
    for f in CONSENSUS_FIELDS:
        key = F.col(f"key_{f}")
        says = key.isNotNull()
        aggs += [
            F.min(F.when(says, key)).alias(f"least_{f}"),
            F.max(F.when(says, key)).alias(f"most_{f}"),
            F.max_by(offer(f), F.when(says, name)).alias(f"said_{f}"),
        ]
    for f in DATE_FIELDS:
        aggs.append(F.bool_or(F.col(f).isNotNull() & day(F.col(f)).isNull()).alias(f"invalid_{f}"))
    g = p.groupBy("number").agg(*aggs)

    only = F.col("n_permits") == 0
    base = F.coalesce("base_permit", "base_directive")
    g = g.withColumns({"existing_only": only, "base": base})
    start = {f: F.when(~only & ((day(F.col(f"base.{f}")).isNotNull()) if f in DATE_FIELDS else F.lit(True)), F.col(f"base.{f}")) for f in EVIDENCE_FIELDS}
    chosen: dict[str, Column] = {}
    for f in CONSENSUS_FIELDS:
        agree = start[f].isNull() & F.col(f"least_{f}").isNotNull() & (F.col(f"least_{f}") == F.col(f"most_{f}"))
        chosen[f] = F.when(agree, F.col(f"said_{f}"))
    for f in LATEST_FIELDS:
        later = F.col(f"latest_{f}").isNotNull() & (start[f].isNull() | (day(F.col(f"latest_{f}.value")) > day(start[f])))
        chosen[f] = F.when(later, F.col(f"latest_{f}"))
    g = g.withColumns({f"start_{f}": start[f] for f in EVIDENCE_FIELDS}).withColumns({f"won_{f}": chosen[f] for f in EVIDENCE_FIELDS})
    final = {f: F.coalesce(F.col(f"won_{f}.value"), F.col(f"start_{f}")) for f in EVIDENCE_FIELDS}
    conflict = {f: F.col(f"start_{f}").isNull() & (F.col(f"least_{f}") < F.col(f"most_{f}")) for f in CONSENSUS_FIELDS}

    def entries(of, kind: str) -> Column:
        items = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), of(f).alias("value")) for f in EVIDENCE_FIELDS]), lambda x: x.value.isNotNull())
        return F.map_from_entries(items).cast(kind)

    won = lambda f: F.col(f"won_{f}").isNotNull()
    kept = lambda f: F.col(f"start_{f}").isNotNull()
    primary = F.coalesce(F.col("won_changed"), F.col("won_end"))
    issues = F.filter(
        F.array(
            *[
                F.when(
                    conflict[f],
                    F.struct(
                        F.lit(f"conflicting_directive_field:{f}").alias("code"),
                        F.lit(f).alias("field"),
                        F.lit(f"Связанные изменения содержат разные значения поля «{LABELS[f]}»; автоматический перенос поля не выполнен.").alias("message"),
                    ),
                )
                for f in CONSENSUS_FIELDS
            ]
        ),
        lambda x: x.isNotNull(),
    ).cast(f"array<{ISSUE}>")
    out = g.select(
        "number",
        *[final[f].alias(f) for f in EVIDENCE_FIELDS],
        F.coalesce(primary["pdf"], F.col("base.pdf")).alias("pdf"),
        F.coalesce(primary["filename"], F.col("base.filename")).alias("filename"),
        "existing_only",
        entries(lambda f: F.when(won(f), F.col(f"won_{f}.provenance")).when(kept(f), F.col("base.field_provenance")[f]), "map<string,string>").alias("field_provenance"),
        entries(lambda f: F.when(won(f), F.col(f"won_{f}.pdf")).when(kept(f), F.col("base.pdf")), "map<string,string>").alias("field_sources"),
        entries(lambda f: F.when(won(f), F.col(f"won_{f}.quality")).when(kept(f), F.col("base.field_quality")[f]), "map<string,struct<status:string,reason:string,confidence:double>>").alias("field_quality"),
        issues.alias("merge_issues"),
        F.col("base.warnings").alias("base_warnings"),
        *[F.col(f"invalid_{f}") for f in DATE_FIELDS],
        F.col("n_versions").cast("long"),
        F.col("n_linked").cast("long"),
    )
    return _with_warnings(out)


def _with_warnings(merged: DataFrame) -> DataFrame:
    """Warnings of the base without codes of fields that are filled now, plus missing fields, lost dates and issues."""
    filled = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in EVIDENCE_FIELDS]), lambda x: x.isNotNull())
    missing = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in EVIDENCE_FIELDS]), lambda x: x.isNotNull())
    lost = F.filter(F.array(*[F.when(F.col(f).isNull() & F.col(f"invalid_{f}"), F.lit(f"invalid_date:{f}")) for f in DATE_FIELDS]), lambda x: x.isNotNull())
    carried = F.filter("base_warnings", lambda x: ~F.coalesce(F.array_contains(filled, x), F.lit(False)))
    warnings = F.array_distinct(F.concat(carried, missing, lost, F.transform("merge_issues", lambda i: i.code)))
    return merged.withColumn("warnings", warnings).drop("base_warnings", *[f"invalid_{f}" for f in DATE_FIELDS])


def unlinked_directives(records: DataFrame) -> DataFrame:
    """Amendments that carry no evidence, with their diagnosis: ``(number, pdf, filename, warnings, error)``."""
    p = _prepared(records).where("amendment AND n_evidence = 0")
    return p.select("number", "pdf", "filename", F.array(F.lit("unlinked_directive")).alias("warnings"), F.lit("Изменение/продление не связано: недостаточно подтверждённых данных.").alias("error")).distinct()


def merge_sources(records: DataFrame) -> DataFrame:
    """``(number, filename)``: the base's file and those of all linked amendments; of amendments only, all of them."""
    base = merge_bases(records).select("number", "filename")
    p = _prepared(records)
    linked = p.where("amendment AND n_evidence > 0").select("number", "filename")
    bare = p.groupBy("number").agg(F.count_if(~F.col("amendment")).alias("n")).where("n = 0").select("number")
    directives = p.where("amendment").select("number", "filename").join(bare, "number", "left_semi")
    return base.unionByName(linked).unionByName(directives).distinct()


def merge_bases(records: DataFrame) -> DataFrame:
    """``(number, filename, pdf, n_evidence, n_permits)``: the version each permit is built on."""
    p = _prepared(records)
    rank = F.struct("n_evidence", F.coalesce(day(F.col("changed")), F.lit("0001-01-01").cast("date")).alias("d"), F.coalesce("filename", F.lit("")).alias("f"), F.coalesce("pdf", F.lit("")).alias("p"))
    top = F.max(F.struct((~F.col("amendment")).alias("permit"), rank.alias("rank"), F.col("filename").alias("filename"), F.col("pdf").alias("pdf"))).alias("t")
    g = p.groupBy("number").agg(top, F.count_if(~F.col("amendment")).cast("long").alias("n_permits"))
    return g.select("number", "t.filename", "t.pdf", F.col("t.rank.n_evidence").cast("long").alias("n_evidence"), "n_permits")
