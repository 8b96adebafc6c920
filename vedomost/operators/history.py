"""Operator actions: validation of a carried-over history, approvals and edits in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vedomost.functions.text import edit_value
from vedomost.schemas import FIRST_ROW, LABELS, TRANSFER_FIELDS

# What a history item may be.
STATUS_OF = {"proposal_approved": "approved", "manual_edit": "edited"}
MAX_ACTIONS = 10_000
INVALID, STALE = "invalid", "stale"


def validate_histories(states: DataFrame, schema_id: str) -> DataFrame:
    """``states(id, schema, register_sha256, current_sha256, actions)`` to ``(id, accepted, warning, n_actions)``.

    A history is taken whole or not at all. No state (NULL schema) is empty without a warning; a wrong schema, digest, item or more than
    10,000 actions is ``invalid``; another register's digest is ``stale``.
    """
    fields = [LABELS[f] for f in TRANSFER_FIELDS]
    good = lambda a: F.coalesce(
        ((a.type == "proposal_approved") & (a.status == "approved") | (a.type == "manual_edit") & (a.status == "edited")) & (a.row >= FIRST_ROW) & a.field.isin(*fields), F.lit(False)
    )
    digest = F.coalesce(F.col("register_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    items = F.col("actions").isNotNull() & (F.size("actions") <= MAX_ACTIONS) & F.forall(F.coalesce("actions", F.array().cast("array<struct<type:string,row:int,field:string,status:string>>")), good)
    warning = F.when(F.col("schema").isNull(), None).when((F.col("schema") != schema_id) | ~digest, INVALID).when(F.col("register_sha256") != F.col("current_sha256"), STALE).when(~items, INVALID)
    accepted = F.col("schema").isNotNull() & warning.isNull()
    return states.select("id", accepted.alias("accepted"), warning.alias("warning"), F.when(accepted, F.size("actions")).otherwise(0).alias("n_actions"))


def validate_item_groups(items: DataFrame, group: str, valid) -> DataFrame:
    """All-or-nothing over long histories kept as rows: ``(group, n_items, accepted)``; one bad item rejects its group."""
    return items.groupBy(group).agg(F.count("*").alias("n_items"), F.bool_and(F.coalesce(valid, F.lit(False))).alias("accepted"))


def resolve_actions(actions: DataFrame) -> DataFrame:
    """What becomes of approvals and edits that were reserved in an order.

    ``actions(seq, number, field, kind, value, version)``, version being the register version the action was reserved on. Of
    actions on one cell and version the lowest seq wins and the others are ``stale``; a later version supersedes an earlier
    one and both stay in the history. Result: the actions with ``status`` approved, edited, stale or invalid, the ``clean`` value and
    ``current`` for the value that stands.
    """
    checked = actions.withColumn("_v", edit_value(F.col("field"), F.col("value")))
    ok = F.col("_v.error").isNull()
    same = Window.partitionBy("number", "field", "version", ok).orderBy("seq")
    cell = Window.partitionBy("number", "field", F.col("status").isin("approved", "edited")).orderBy(F.col("version").desc(), F.col("seq").desc())
    done = F.when(F.col("kind") == "manual_edit", "edited").otherwise("approved")
    told = checked.withColumn("status", F.when(~ok, "invalid").when(F.row_number().over(same) > 1, "stale").otherwise(done))
    told = told.withColumn("current", F.col("status").isin("approved", "edited") & (F.row_number().over(cell) == 1))
    return told.withColumn("clean", F.when(F.col("status").isin("approved", "edited"), F.col("_v.value"))).drop("_v")


def resolve_proposals(proposals: DataFrame, resolved: DataFrame) -> DataFrame:
    """Proposals with their status after the actions: an edit of the same cell settles even an approved proposal."""
    last = resolved.where("current").select("number", "field", F.col("status").alias("_s"))
    j = proposals.join(last, ["number", "field"], "left")
    return j.withColumn("status", F.when(F.col("_s") == "edited", "resolved_manual").when((F.col("_s") == "approved") & (F.col("status") == "pending"), "approved").otherwise(F.col("status"))).drop("_s")


def action_events(resolved: DataFrame) -> DataFrame:
    """One event per action that took effect, for the history: ``(seq, type, number, field, status)``."""
    kind = F.when(F.col("kind") == "manual_edit", "manual_edit").otherwise("proposal_approved")
    return resolved.where(F.col("status").isin("approved", "edited")).select("seq", kind.alias("type"), "number", "field", "status")
