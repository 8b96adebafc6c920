"""Candidate values assigned to empty fields by an outside model, taken only if the whole assignment is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vedomost.functions.values import overlay
from vedomost.schemas import EVIDENCE_FIELDS

# Limits of a candidate list.
MOST, ID_LENGTH, VALUE_LENGTH, BYTES = 16, 128, 1024, 16 * 1024
CANDIDATES = "array<struct<id:string,value:string,allowed_targets:array<string>>>"
ASSIGNMENTS = "array<struct<candidate_id:string,target:string>>"


def candidates_ok(c: Column) -> Column:
    """Whether a candidate list keeps every limit; one violation drops all."""
    each = F.forall(
        c,
        lambda x: F.coalesce(
            (F.length(x.id) > 0) & (F.length(x.id) <= ID_LENGTH) & (F.length(x.value) > 0) & (F.length(x.value) <= VALUE_LENGTH) & (F.size(x.allowed_targets) > 0)
            & (F.size(F.array_distinct(x.allowed_targets)) == F.size(x.allowed_targets)) & F.forall(x.allowed_targets, lambda t: t.isin(*EVIDENCE_FIELDS)),
            F.lit(False),
        ),
    )
    ids = F.transform(c, lambda x: x.id)
    return F.coalesce((F.size(c) > 0) & (F.size(c) <= MOST) & each & (F.size(F.array_distinct(ids)) == F.size(c)) & (F.octet_length(F.to_json(c)) <= BYTES), F.lit(False))


def apply_assignments(records: DataFrame) -> DataFrame:
    """``records`` with candidates and assignments applied where they are one to one, complete, allowed and meet empty fields only.

    Any violation leaves the record as it is. Filled fields get provenance ``mapping_llm`` and lose their warning.
    """
    c, a = F.col("mapping_candidates"), F.col("assignments")
    ids, targets = F.transform(a, lambda x: x.candidate_id), F.transform(a, lambda x: x.target)
    allowed = F.forall(a, lambda x: F.exists(c, lambda k: (k.id == x.candidate_id) & F.array_contains(k.allowed_targets, x.target)))
    empty = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in EVIDENCE_FIELDS]), lambda x: x.isNotNull())
    sound = candidates_ok(c) & (F.size(a) == F.size(c)) & (F.size(F.array_distinct(ids)) == F.size(c)) & (F.size(F.array_distinct(targets)) == F.size(c)) & allowed & (F.size(F.array_except(targets, empty)) == 0)
    r = records.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    chosen = F.map_from_entries(F.transform(a, lambda x: F.struct(x.target.alias("key"), F.element_at(F.filter(c, lambda k: k.id == x.candidate_id), 1).value.alias("value"))))
    r = r.withColumn("_new", F.when(F.col("_ok"), chosen).otherwise(F.create_map().cast("map<string,string>")))
    filled = F.map_keys("_new")
    changed = {f: F.coalesce(F.col(f), F.col("_new")[f]) for f in EVIDENCE_FIELDS}
    changed["field_provenance"] = overlay(F.col("field_provenance"), F.transform_values("_new", lambda k, v: F.lit("mapping_llm")))
    changed["warnings"] = F.filter("warnings", lambda w: ~F.array_contains(filled, w))
    return r.withColumns(changed).drop("_ok", "_new")
