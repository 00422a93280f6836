"""Conversation histories in state: the masked messages themselves, gone when they expire."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusdesk.functions.pii import mask_pii
from corpusdesk.params import MAX_HISTORY_CHARS, MAX_MESSAGES, RETENTION
from corpusdesk.streaming.jobs import run_batches, thin
from corpusdesk.streaming.state import block_of

MESSAGE = "turn bigint, role string, content string, ts string"
_FIELDS = ", ".join(f.strip().replace(" ", ":") for f in MESSAGE.split(","))
STORED_SCHEMA = f"conv_id bigint, messages array<struct<{_FIELDS}>>, expired boolean"
KEPT = f"array<struct<{_FIELDS}, size:bigint>>"


class Messages(StatefulProcessor):
    """The newest messages within both limits, of each conversation of a block, until ``keep_ms`` after its last one.

    As in ``state.History`` messages may come in any order, and what is older than a
    message that has been left out stays out.  The timer of a block follows the
    conversation that ends first; when the watermark passes the end of a conversation,
    nothing of it is left.
    """

    def __init__(self, max_messages: int, max_chars: int, keep_ms: int) -> None:
        self._max_messages, self._max_chars, self._keep_ms = max_messages, max_chars, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", f"due bigint, convs array<struct<conv_id:bigint,ends:bigint,floor:bigint,kept:{KEPT}>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, held = self._load()
        changed = {}
        for batch in rows:
            come = defaultdict(list)
            for conv, at, *m in zip(*(batch[c] for c in ("conv_id", "at", "turn", "role", "content", "shown", "size"))):
                come[int(conv)].append((int(at), (int(m[0]), *m[1:4], int(m[4]))))
            for conv, more in come.items():
                ends, floor, kept = changed.get(conv) or held.get(conv) or (0, None, {})
                ends = max(ends, max(at for at, _ in more) + self._keep_ms)
                kept = kept | {m[0]: m for _, m in more if floor is None or m[0] > floor}
                newest = sorted(kept)
                if len(newest) > self._max_messages:
                    floor = newest[-self._max_messages - 1]
                    kept = {turn: kept[turn] for turn in newest[-self._max_messages:]}
                changed[conv] = ends, floor, kept
        for conv, (ends, floor, kept) in changed.items():
            changed[conv] = ends, *self._fitting(floor, kept)
        held |= changed
        first = min(ends for ends, _, _ in held.values())
        if first != due:
            if due is not None:
                self._handle.deleteTimer(due)
            self._handle.registerTimer(first)
        self._store(first, held)
        names = ("turn", "role", "content", "ts")
        yield pd.DataFrame({
            "conv_id": list(changed), "expired": False,
            "messages": [[dict(zip(names, m)) for m in kept.values()] for _, _, kept in changed.values()]})[["conv_id", "messages", "expired"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self._load()
        # Ends before the watermark are due with the one whose timer it is.
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        gone = [conv for conv, (ends, _, _) in held.items() if ends <= over]
        left = {conv: c for conv, c in held.items() if c[0] > over}
        if left:
            first = min(ends for ends, _, _ in left.values())
            self._handle.registerTimer(first)
            self._store(first, left)
        else:
            self._held.clear()
        yield pd.DataFrame({"conv_id": gone, "messages": [[] for _ in gone], "expired": [True] * len(gone)})

    def _load(self) -> tuple[int | None, dict[int, tuple]]:
        """When the timer is due, and (ends, floor, messages by turn) of each conversation."""
        due, convs = self._held.get() or (None, [])
        return due, {conv: (ends, floor, {m[0]: tuple(m) for m in kept}) for conv, ends, floor, kept in convs}

    def _store(self, due: int, held: dict[int, tuple]) -> None:
        self._held.update((due, [(conv, ends, floor, list(kept.values())) for conv, (ends, floor, kept) in held.items()]))

    def _fitting(self, floor: int | None, kept: dict[int, tuple]) -> tuple[int | None, dict[int, tuple]]:
        total, fitting = 0, []
        for turn in sorted(kept, reverse=True):
            total += kept[turn][4] + 2
            if fitting and total > self._max_chars:
                floor = turn
                break
            fitting.append(turn)
        return floor, {turn: kept[turn] for turn in reversed(fitting)}

    def close(self) -> None:
        pass


def stored_histories(messages: DataFrame, delay: str, max_messages: int = MAX_MESSAGES, max_chars: int = MAX_HISTORY_CHARS,
                     keep: timedelta = timedelta(days=RETENTION.conversation_days)) -> DataFrame:
    """Changes of (conv_id, messages, expired) from (conv_id, turn, role, content, ts, size).

    ``size`` is the length of the message as JSON, ``ts`` its time; rows without conv_id,
    turn or ts belong to no history.  Contents are masked before they reach the state.
    A turn that comes again replaces the one before.  Rows that are later than
    ``delay`` are dropped.  A busy conversation is cut to its newest messages in every
    Arrow batch before rows are exchanged.
    """
    usable = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("ts").isNotNull())
    masked = usable.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", mask_pii(F.col("content")).alias("content"), "ts",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("shown"), F.unix_millis("ts").alias("at"),
        F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"))
    newest = thin(masked, lambda rows: rows.sort_values("turn").groupby("conv_id").tail(max_messages))
    return newest.withColumn("block", block_of(F.col("conv_id"))).withWatermark("ts", delay).groupBy("block").transformWithStateInPandas(
        statefulProcessor=Messages(max_messages, max_chars, int(keep.total_seconds() * 1000)),
        outputStructType=STORED_SCHEMA, outputMode="Update", timeMode="EventTime")


def run_histories(changes: DataFrame, path: str) -> DataFrame:
    """Process all that is there; (conv_id, messages) of the conversations that have not expired.

    Each micro-batch overwrites its own folder, so one that is run again counts once;
    the last change of a conversation holds, and an expiry is later than a message of the same batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(changes, path, write, "update")
    spark = changes.sparkSession
    written = spark.read.schema(f"{STORED_SCHEMA}, batch bigint").parquet(path)
    last = written.groupBy("conv_id").agg(F.max_by(F.struct("messages", "expired"), F.struct("batch", "expired")).alias("last"))
    return last.where("not last.expired").select("conv_id", "last.messages")
