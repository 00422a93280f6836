"""Table-level steps of incoming mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusdesk.functions import mail
from corpusdesk.params import QUERY, QueryParams


def dedupe_messages(incoming: DataFrame, store: DataFrame, message_id: str = "message_id",
                    order: tuple[str, ...] = ()) -> DataFrame:
    """Unseen messages, one row per id: the first one by ``order`` (arrival, then row id).

    Rows of the same place in the order are told apart by their content.  Rows are
    reduced map-side before the join.
    """
    rest = [c for c in incoming.columns if c not in order and c != message_id]
    stamp = F.struct(*order, F.xxhash64(*rest)) if rest else F.struct(*order, F.lit(0))
    first = incoming.groupBy(message_id).agg(F.min_by(F.struct(*incoming.columns), stamp).alias("_first")).select("_first.*")
    return first.join(store.select(message_id), message_id, "left_anti")


def keep_personal(mails: DataFrame, headers: str = "headers", sender: str = "sender") -> DataFrame:
    return mails.where(~mail.is_auto_reply(F.col(headers), F.col(sender)))


def build_query(mails: DataFrame, body: str = "body", subject: str = "subject", intent: str = "intent",
                confidence: str = "confidence", p: QueryParams = QUERY) -> DataFrame:
    """Adds ``text`` (cleaned search text) and drops an intent that is not trusted."""
    raw = F.coalesce(F.nullif(F.col(body), F.lit("")), F.nullif(F.col(subject), F.lit("")), F.lit(""))
    return mails.withColumn("text", mail.search_text(raw, p)).withColumn(
        intent, mail.trusted_intent(F.col(intent), F.col(confidence), p))


def label_frame(spark: SparkSession, labels: dict[str, str], key: str, value: str) -> DataFrame:
    """A small fixed lookup table."""
    return spark.createDataFrame(list(labels.items()), f"{key} string, {value} string")


def route_department(requests: DataFrame, departments: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """intent -> department -> mailbox; unknown ones stay null.  Both lookups are fixed tables."""
    return requests.join(F.broadcast(departments), "intent", "left").join(F.broadcast(mailboxes), "department", "left")


def auto_approve(replies: DataFrame, settings: DataFrame, now: Column) -> DataFrame:
    """PILOT approves by itself, CO_PILOT waits for a review.  ``settings`` is one row."""
    pilot = settings.agg(F.first("mode")).scalar() == "PILOT"
    return replies.withColumns({
        "status": F.when(pilot, "APPROVED").otherwise("PENDING_REVIEW"),
        "auto_approved": pilot,
        "reviewed_by": F.when(~pilot, F.col("reviewed_by")),
        "reviewed_at": F.when(pilot, now).otherwise(F.col("reviewed_at")),
    })


def draft_queries(drafts: DataFrame, labels: DataFrame, collected: str = "collected") -> DataFrame:
    """Adds subject (the intent's label) and text (collected values, else the label)."""
    named = drafts.join(F.broadcast(labels), "intent", "left").withColumn("subject", F.coalesce("label", "intent"))
    return named.withColumn("text", mail.draft_query(F.col(collected), F.col("subject"))).drop("label")
