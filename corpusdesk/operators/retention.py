"""Expiry dates, scheduled purge, erasure on request, clearing on completion."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusdesk.params import RETENTION
from corpusdesk.sources.snapshots import SnapshotTable
from corpusdesk.sources.workdir import members

EMPTY_MESSAGES = "[]"
NEVER = "never"  # the partition of rows without an expiry date
FINISHED = "finished"  # the note of months that hold nothing more to purge
DRAFT_DONE = ("SENT", "REJECTED")
INCOMING_DONE = ("REPLIED",)


def expires(start: Column, days: int) -> Column:
    return start + F.make_dt_interval(F.lit(days))


def expiry_dates(df: DataFrame, started: str, sent: str, now: Column) -> DataFrame:
    return df.withColumns({
        "conversation_expires": expires(F.col(started), RETENTION.conversation_days),
        "log_expires": expires(F.col(sent), RETENTION.log_days),
        "incoming_expires": expires(now, RETENTION.incoming_days),
    })


def is_expired(now: Column) -> Column:
    return (F.col("retention_expires_at") <= now) & F.col("deleted_at").isNull()


@dataclass
class Purged:
    conversations: DataFrame
    drafts: DataFrame
    logs: DataFrame
    incoming: DataFrame
    counts: DataFrame


def _soft_delete(df: DataFrame, now: Column, blank: dict[str, Column]) -> DataFrame:
    expired = is_expired(now)
    changed = {name: F.when(expired, value).otherwise(F.col(name)) for name, value in blank.items()}
    return df.withColumns({**changed, "deleted_at": F.when(expired, now).otherwise(F.col("deleted_at"))})


def _blanks(blank_logs: bool) -> dict[str, dict[str, Column]]:
    """What a purge puts in place of the content, per table."""
    nothing = F.lit(None).cast("string")
    return {
        "conversations": {"messages": F.lit(EMPTY_MESSAGES)},
        "logs": {"subject": nothing, "body_masked": nothing} if blank_logs else {},
        "incoming": {"sender": F.lit(""), "body_text": nothing, "body_html": nothing, "reply_body": nothing},
    }


def retention_purge(conversations: DataFrame, drafts: DataFrame, logs: DataFrame, incoming: DataFrame,
                    now: Column, blank_logs: bool = False) -> Purged:
    """All tables after the purge at ``now``, and the number of rows purged per table."""
    blank = _blanks(blank_logs)
    return Purged(
        conversations=_soft_delete(conversations, now, blank["conversations"]),
        drafts=clear_drafts_of(drafts, conversations.where(is_expired(now))),
        logs=_soft_delete(logs, now, blank["logs"]),
        incoming=_soft_delete(incoming, now, blank["incoming"]),
        counts=purge_counts({"conversations": conversations, "logs": logs, "incoming": incoming}, now),
    )


def expiry_month() -> Column:
    """The partition of a row in a table with a retention date."""
    return F.coalesce(F.date_format("retention_expires_at", "yyyy-MM"), F.lit(NEVER))


@dataclass
class RetentionStores:
    """The tables of the scheduled purge: by month of expiry, the drafts by bucket of their conversation."""

    conversations: SnapshotTable
    drafts: SnapshotTable
    logs: SnapshotTable
    incoming: SnapshotTable

    @classmethod
    def at(cls, spark: SparkSession, root: str, buckets: int) -> RetentionStores:
        bucket = F.pmod(F.coalesce(F.xxhash64("conversation_id"), F.lit(0)), F.lit(buckets)).cast("string")
        by = {"conversations": expiry_month(), "drafts": bucket, "logs": expiry_month(), "incoming": expiry_month()}
        return cls(**{name: SnapshotTable(spark, f"{root}/{name}", part) for name, part in by.items()})


def add_rows(table: SnapshotTable, rows: DataFrame) -> None:
    """Append to a table of the purge; a finished month that gets rows is open again."""
    table.append(rows, lambda notes, got: {**notes, FINISHED: [p for p in notes.get(FINISHED, []) if p not in got]})


def scheduled_purge(stores: RetentionStores, now: datetime, blank_logs: bool = False, at_once: int = 12) -> DataFrame:
    """Purge what has expired by ``now`` in the stored tables: (table_name, purged).

    Only months that are due are read, and of these only those with expired rows are
    written, ``at_once`` of them per committed version.  Months that ended before ``now`` are noted
    as finished in the table and never read again, so a purge that was interrupted
    goes on behind its last commit and a second run finds at most the current month.
    The drafts of a conversation are cleared before it counts as purged.
    """
    spark = stores.drafts.spark
    at, month = F.lit(now.isoformat(sep=" ")).cast("timestamp"), now.strftime("%Y-%m")
    purged = {}
    for name, blank in _blanks(blank_logs).items():
        table, purged[name] = getattr(stores, name), 0
        base = table.current()
        due = sorted(p for p in base.parts if p != NEVER and p <= month and p not in base.notes.get(FINISHED, []))
        for first in range(0, len(due), at_once):
            some, base = due[first:first + at_once], table.current()
            expired = table.read(some, base).where(is_expired(at))
            hits = {r[0]: r[1] for r in expired.groupBy(table.part.alias("part")).agg(F.count(F.lit(1))).collect()}
            if hits and name == "conversations":
                _clear_stored_drafts(stores.drafts, table.read(hits, base).where(is_expired(at)))
            finished = sorted({*base.notes.get(FINISHED, []), *(p for p in some if p < month)})
            if hits or finished != base.notes.get(FINISHED, []):
                rows = _soft_delete(table.read(hits, base), at, blank)
                table.replace(rows, hits, base, {**base.notes, FINISHED: finished})
            purged[name] += sum(hits.values())
    return spark.createDataFrame(sorted(purged.items()), "table_name string, purged long")


def _clear_stored_drafts(drafts: SnapshotTable, conversations: DataFrame) -> None:
    base = drafts.current()
    touched = [r[0] for r in conversations.select(drafts.part).distinct().collect()]
    drafts.replace(clear_drafts_of(drafts.read(touched, base), conversations), [t for t in touched if t in base.parts], base)


def purge_counts(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count_if(is_expired(now)).alias("purged")).select(F.lit(name).alias("table_name"), "purged")
        out = one if out is None else out.unionByName(one)
    return out


def clear_drafts_of(drafts: DataFrame, conversations: DataFrame) -> DataFrame:
    """Null the encrypted fields of all drafts that belong to the conversations."""
    return _cleared(drafts, _marked(conversations))


def _marked(conversations: DataFrame) -> DataFrame:
    return members(conversations, "conversation_id").withColumn("_hit", F.lit(True))


def _cleared(drafts: DataFrame, hit: DataFrame) -> DataFrame:
    return drafts.join(hit, "conversation_id", "left").withColumn(
        "fields_enc", F.when(F.col("_hit").isNull(), F.col("fields_enc"))
    ).drop("_hit")


def erase_subject(conversations: DataFrame, drafts: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Right to erasure for every conversation in ``requests``; mail logs stay."""
    hit = _marked(requests)
    asked = F.col("_hit").isNotNull()
    erased = conversations.join(hit, "conversation_id", "left").withColumns({
        "messages": F.when(asked, EMPTY_MESSAGES).otherwise(F.col("messages")),
        "deleted_at": F.when(asked, now).otherwise(F.col("deleted_at")),
    }).drop("_hit")
    return erased, _cleared(drafts, hit)


def clear_terminal_pii(df: DataFrame, columns: list[str], states: tuple[str, ...] = DRAFT_DONE) -> DataFrame:
    done = F.col("status").isin(*states)
    return df.withColumns({c: F.when(~done, F.col(c)) for c in columns})
