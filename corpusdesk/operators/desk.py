"""Operational reports: counters, breakdowns, feeds, queues, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusdesk.operators.corpus import visible

# Statuses.
DRAFT_STATES = ("IDLE", "COLLECTING_INFO", "DRAFT_CREATED", "PENDING_APPROVAL", "APPROVED",
                "SENT", "REJECTED", "FAILED", "CANCELLED")
DRAFT_CLOSED = ("SENT", "REJECTED", "CANCELLED", "FAILED")
INCOMING_IN_REVIEW = ("PENDING_REVIEW", "APPROVED", "REPLIED", "SKIPPED", "FAILED")
# How the queue shows an incoming mail's status.
QUEUE_STATUS = {"PENDING_REVIEW": "PENDING_APPROVAL", "REPLIED": "SENT", "SKIPPED": "REJECTED"}
QUEUE_FILTERS = ("PENDING_APPROVAL", "APPROVED", "SENT", "REJECTED", "FAILED")
BADGE_CAP = 200


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Several one-row aggregates as the columns of one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def dashboard_stats(drafts: DataFrame, logs: DataFrame, docs: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    today = F.date_trunc("day", now)
    return _one_row([
        drafts.agg(F.count_if(F.col("status") == "PENDING_APPROVAL").alias("pending_drafts")),
        logs.agg(F.count_if((F.col("sent_at") >= today) & F.col("deleted_at").isNull()).alias("sent_today")),
        visible(docs).agg(F.count(F.lit(1)).alias("indexed_documents")),
        incoming.agg(
            F.count_if(F.col("status") == "PENDING_REVIEW").alias("pending_incoming"),
            F.count_if((F.col("reply_sent_at") >= today) & (F.col("status") == "REPLIED")).alias("replied_today"),
        ),
    ])


def intent_breakdown(intents: DataFrame, now: Column, days: int = 7) -> DataFrame:
    since = now - F.make_dt_interval(F.lit(days))
    return intents.where(F.col("detected_at") >= since).groupBy("intent_type").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "intent_type")


def share_of_max(breakdown: DataFrame, count: str = "n") -> DataFrame:
    """Bar length in percent of the largest count."""
    top = breakdown.agg(F.greatest(F.max(count), F.lit(1))).scalar()
    return breakdown.withColumn("percent", F.round(F.least(F.lit(100.0), F.col(count) / top * 100), 6))


def activity_feed(intents: DataFrame, limit: int = 50) -> DataFrame:
    return intents.orderBy(F.desc("detected_at"), F.desc("id")).limit(limit)


def display_name(name: Column, digest: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("#"), F.substring(digest, 1, 8)))


def unified_queue(drafts: DataFrame, incoming: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Drafts and incoming replies in one list, newest first."""
    if status is not None and status not in QUEUE_FILTERS:
        return drafts.limit(0).select(*_draft_items())
    back = {shown: own for own, shown in QUEUE_STATUS.items()}
    d = drafts if status is None else drafts.where(F.col("status") == status)
    i = incoming.where("deleted_at is null")
    i = i.where(F.col("status").isin(*INCOMING_IN_REVIEW)) if status is None else i.where(
        F.col("status") == back.get(status, status))
    newest = [F.desc("created_at"), F.asc("item_type"), F.desc("id")]
    shown = reduce(lambda c, m: c.when(F.col("status") == m[0], m[1]), list(QUEUE_STATUS.items())[1:],
                   F.when(F.col("status") == "PENDING_REVIEW", QUEUE_STATUS["PENDING_REVIEW"])).otherwise(F.col("status"))
    items_d = d.select(*_draft_items()).orderBy(*newest).limit(limit)
    items_i = i.select(
        F.col("id").cast("string").alias("id"), F.lit("incoming_reply").alias("item_type"), shown.alias("status"),
        F.coalesce(F.nullif(F.col("reply_subject"), F.lit("")), F.col("subject")).alias("subject"),
        F.lit(None).cast("string").alias("recipient_display"),
        display_name(F.col("sender_name"), F.col("sender_hash")).alias("sender_display"),
        "intent_type", F.col("received_at").alias("created_at"), "send_attempts", "last_error",
    ).orderBy(*newest).limit(limit)
    return items_d.unionByName(items_i).orderBy(*newest).limit(limit)


def _draft_items() -> list:
    return [
        F.col("id").cast("string").alias("id"), F.lit("draft").alias("item_type"), "status", "subject",
        F.col("recipient").alias("recipient_display"), F.lit(None).cast("string").alias("sender_display"),
        "intent_type", "created_at", "send_attempts", "last_error",
    ]


def list_page(df: DataFrame, filters: dict[str, object], newest: str, tie: str, offset: int, limit: int,
              allowed: dict[str, tuple] | None = None) -> DataFrame:
    """One page of a table; an unknown value of a checked filter is an error."""
    for name, value in filters.items():
        if value is None:
            continue
        if allowed and name in allowed and value not in allowed[name]:
            raise ValueError(f"unknown {name}: {value}")
        df = df.where(F.col(name) == value)
    return df.orderBy(F.desc(newest), F.desc(tie)).offset(offset).limit(limit)


def log_range(logs: DataFrame, start: Column, end: Column) -> DataFrame:
    return logs.where(F.col("sent_at").between(start, end) & F.col("deleted_at").isNull())


def pending_badges(drafts: DataFrame, incoming: DataFrame, cap: int | None = None) -> DataFrame:
    """One row (drafts, incoming) of open items; a badge with little room shows at most ``cap``."""
    def badge(df: DataFrame, state: str, name: str) -> DataFrame:
        n = F.count_if(F.col("status") == state)
        return df.agg((n if cap is None else F.least(n, F.lit(cap))).alias(name))

    return _one_row([badge(drafts, "PENDING_APPROVAL", "drafts"), badge(incoming, "PENDING_REVIEW", "incoming")])


def active_drafts(drafts: DataFrame) -> DataFrame:
    """(conversation_id, active, several) for conversations with an open draft."""
    return drafts.where(~F.col("status").isin(*DRAFT_CLOSED)).groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("active")).withColumn("several", F.col("active") > 1)


def latest_per_key(df: DataFrame, key: str, row_id: str, now: Column) -> DataFrame:
    """Newest live row per key stays, its other live rows are soft-deleted.

    The winner per key is a map-side maximum; rows then meet it on their unique
    id, so a key with very many rows makes no large group.
    """
    rank = F.struct(
        F.col("last_active_at").isNotNull().alias("has"), F.col("last_active_at").alias("a"),
        F.col("started_at").alias("s"), F.col(row_id).alias("i"))
    live = F.col("deleted_at").isNull()
    winners = df.where(live).groupBy(key).agg(F.max(rank).alias("w")).select(
        F.col("w.i").alias(row_id), F.lit(True).alias("_newest"))
    return df.join(winners, row_id, "left").withColumn(
        "deleted_at", F.when(live & F.col("_newest").isNull(), now).otherwise(F.col("deleted_at"))).drop("_newest")


def conversation_cards(events: DataFrame, key: str, ts: str, row_id: str, fields: dict[str, str]) -> DataFrame:
    """Per conversation the latest non-null value of each field, newest first."""
    at = F.struct(ts, row_id)
    latest = [F.max_by(source, F.when(F.col(source).isNotNull(), at)).alias(name) for name, source in fields.items()]
    return events.groupBy(key).agg(*latest, F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events")).orderBy(
        F.desc("last_ts"), key)


def work_backlog(drafts: DataFrame, incoming: DataFrame, docs: DataFrame) -> DataFrame:
    """(queue, id) of everything that waits for a worker."""

    def part(df: DataFrame, queue: str, states: tuple[str, ...], key: str) -> DataFrame:
        return df.where(F.col("status").isin(*states)).select(F.lit(queue).alias("queue"), F.col(key).cast("string").alias("id"))

    parts = [
        part(drafts, "send_draft", ("APPROVED",), "id"),
        part(incoming, "analyze", ("RECEIVED",), "id"),
        part(incoming, "send_reply", ("APPROVED",), "id"),
        part(docs.where("deleted_at is null"), "index", ("PENDING", "PROCESSING"), "doc_id"),
    ]
    return reduce(DataFrame.unionByName, parts)
