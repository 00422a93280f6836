"""Status machines: audits, retries, edits and review batches.

Transition tables are small fixed DataFrames ``(from_status, to_status)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusdesk.operators.windows import last_before
from corpusdesk.params import MAX_SEND_ATTEMPTS

# Allowed status changes of outgoing drafts and of incoming mail.
DRAFT_TRANSITIONS = {
    "IDLE": ("COLLECTING_INFO",),
    "COLLECTING_INFO": ("DRAFT_CREATED", "CANCELLED"),
    "DRAFT_CREATED": ("PENDING_APPROVAL", "CANCELLED"),
    "PENDING_APPROVAL": ("APPROVED", "REJECTED", "CANCELLED"),
    "APPROVED": ("SENT", "FAILED"),
    "REJECTED": (),
    "SENT": (),
    "FAILED": ("APPROVED",),
    "CANCELLED": (),
}
INCOMING_TRANSITIONS = {
    "RECEIVED": ("ANALYZING",),
    "ANALYZING": ("REPLY_GENERATED", "ANALYSIS_FAILED"),
    "REPLY_GENERATED": ("PENDING_REVIEW",),
    "PENDING_REVIEW": ("APPROVED", "SKIPPED"),
    "APPROVED": ("REPLIED", "FAILED"),
    "REPLIED": (),
    "FAILED": ("APPROVED",),
    "SKIPPED": (),
    "ANALYSIS_FAILED": ("RECEIVED",),
}
# Review actions as (kind, action, from, to, clears the error).
REVIEW_ACTIONS = (
    ("draft", "approve", "PENDING_APPROVAL", "APPROVED", False),
    ("draft", "reject", "PENDING_APPROVAL", "REJECTED", False),
    ("incoming", "approve", "PENDING_REVIEW", "APPROVED", False),
    ("incoming", "skip", "PENDING_REVIEW", "SKIPPED", False),
    ("incoming", "reanalyze", "ANALYSIS_FAILED", "RECEIVED", True),
    ("incoming", "reanalyze", "PENDING_REVIEW", "RECEIVED", True),
    ("incoming", "reanalyze", "REPLIED", "RECEIVED", True),
    ("document", "reindex", "FAILED", "PENDING", True),
    ("document", "reindex", "INDEXED", "PENDING", True),
)
EDITABLE = {"draft": ("PENDING_APPROVAL", "DRAFT_CREATED"), "incoming": ("PENDING_REVIEW",)}


def transitions(spark: SparkSession, table: dict[str, tuple]) -> DataFrame:
    rows = [(a, b) for a, nexts in table.items() for b in nexts]
    return spark.createDataFrame(rows, "from_status string, to_status string")


def audit_transitions(history: DataFrame, allowed: DataFrame, entity: str, ts: str, row_id: str, bucket: Column) -> DataFrame:
    """Status changes that ``allowed`` does not list.

    An entity with very many changes is cut into buckets (see ``last_before``);
    the fixed transition table is broadcast.  Rows without an entity have no history
    to compare with and are no violations.
    """
    changes = last_before(history.where(F.col(entity).isNotNull()), [entity], [ts, row_id], "status", "from_status", bucket).where(
        "from_status is not null and from_status <> status")
    return changes.withColumnRenamed("status", "to_status").join(
        F.broadcast(allowed), ["from_status", "to_status"], "left_anti")


def terminal_states(seen: DataFrame, allowed: DataFrame) -> DataFrame:
    """Of the states that occur, those without a successor."""
    return seen.select("status").distinct().join(
        F.broadcast(allowed.select(F.col("from_status").alias("status")).distinct()), "status", "left_anti")


def retry_outcome(attempts: DataFrame, key: str, ts: str, row_id: str, max_attempts: int = MAX_SEND_ATTEMPTS) -> DataFrame:
    """Per key from (key, ok, error, ts): attempts, resulting status, last error."""
    at = F.struct(ts, row_id)
    last_ok, last_any = F.max(F.when(F.col("ok"), at)), F.max(at)
    summary = attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.coalesce(last_ok == last_any, F.lit(False)).alias("sent"),
        F.max_by("error", F.when(~F.col("ok"), at)).alias("error"),
    )
    return summary.select(
        key, "attempts",
        F.when(F.col("sent"), "SENT").when(F.col("attempts") >= max_attempts, "FAILED").otherwise("APPROVED").alias("status"),
        F.when(~F.col("sent"), F.col("error")).alias("last_error"),
    )


def manual_retry(items: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """Only FAILED items return to APPROVED; ``outcome`` is retried, refused or null."""
    asked = requests.select(key).distinct().withColumn("_asked", F.lit(True))
    wanted = F.col("_asked").isNotNull()
    joined = items.join(asked, key, "left").withColumn(
        "outcome", F.when(wanted & (F.col("status") == "FAILED"), "retried").when(wanted, "refused"))
    done = F.coalesce(F.col("outcome") == "retried", F.lit(False))
    return joined.withColumns({
        "status": F.when(done, "APPROVED").otherwise(F.col("status")),
        "last_error": F.when(~done, F.col("last_error")),
    }).drop("_asked")


def apply_edits(items: DataFrame, edits: DataFrame, kind: str, columns: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(items after the edits, refused edits).  Null in an edit means unchanged."""
    new = edits.select(key, F.lit(True).alias("_edit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = items.join(new, key, "left")
    editable = F.col("status").isin(*EDITABLE[kind])
    after = joined.withColumns({
        c: F.when(editable, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)) for c in columns
    }).drop("_edit", *[f"_new_{c}" for c in columns])
    refused = edits.join(items.where(~editable).select(key, "status"), key)
    return after, refused


def apply_reviews(items: DataFrame, actions: DataFrame, kind: str, now: Column, key: str = "id") -> DataFrame:
    """Apply (key, action, reviewer, note); ``outcome`` is applied, refused or null.

    approve/reject/skip record the reviewer and the time; reject stores the note
    as the reason and clears collected fields, skip stores it as a remark.
    """
    spark = items.sparkSession
    rules = spark.createDataFrame(
        [r[1:] for r in REVIEW_ACTIONS if r[0] == kind],
        "action string, status string, _to string, _clears boolean")
    joined = items.join(actions.select(key, "action", "reviewer", "note"), key, "left").join(
        F.broadcast(rules), ["action", "status"], "left")
    done = F.col("_to").isNotNull()
    decides = done & F.col("action").isin("approve", "reject", "skip")
    outcome = F.when(done, "applied").when(F.col("action").isNotNull(), "refused")
    changed = {
        "outcome": outcome,
        "status": F.coalesce("_to", "status"),
        "reviewed_by": F.when(decides, F.col("reviewer")).otherwise(F.col("reviewed_by")),
        "reviewed_at": F.when(decides, now).otherwise(F.col("reviewed_at")),
        "last_error": F.when(~F.coalesce("_clears", F.lit(False)), F.col("last_error")),
    }
    if kind == "draft":
        rejected = done & (F.col("action") == "reject")
        changed["rejection_reason"] = F.when(rejected, F.col("note")).otherwise(F.col("rejection_reason"))
        changed["fields_enc"] = F.when(~F.coalesce(rejected, F.lit(False)), F.col("fields_enc"))
    if kind == "incoming":
        noted = done & (F.col("action") == "skip") & (F.coalesce("note", F.lit("")) != "")
        changed["admin_notes"] = F.when(noted, F.col("note")).otherwise(F.col("admin_notes"))
    return joined.withColumns(changed).drop("action", "reviewer", "note", "_to", "_clears")
