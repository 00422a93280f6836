"""Trimmed conversation histories kept in state."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusdesk.params import MAX_HISTORY_CHARS, MAX_MESSAGES
from corpusdesk.streaming.jobs import thin

HISTORY_SCHEMA = "conv_id bigint, turns array<bigint>, version bigint"
BLOCK_BITS = 6


def block_of(conv_id: Column) -> Column:
    """The block of a conversation: 64 neighbouring ids at most share a state.

    A call of a stateful function in Python costs 5 to 10 ms however few rows it gets,
    so conversations that are called one by one spend their time on that alone.
    """
    return F.shiftright(conv_id, BLOCK_BITS)


class History(StatefulProcessor):
    """The newest messages within both limits, of each conversation of a block.

    The state never holds more than ``max_messages`` rows of a conversation, and each batch is
    cut to that number before it is merged.  Messages may come in any order: what is
    older than a message that has been left out is beyond the limits as well, so the
    newest turn left out is kept too.  The version counts the changes of the block.
    """

    def __init__(self, max_messages: int, max_chars: int) -> None:
        self._max_messages, self._max_chars = max_messages, max_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState(
            "held", "version bigint, convs array<struct<conv_id:bigint,floor:bigint,kept:array<struct<turn:bigint,size:bigint>>>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, convs = self._held.get() or (0, [])
        held = {conv: (floor, [(t, s) for t, s in kept]) for conv, floor, kept in convs}
        changed = {}
        for batch in rows:
            come = defaultdict(list)
            for conv, turn, size in zip(batch["conv_id"], batch["turn"], batch["size"]):
                come[int(conv)].append((int(turn), int(size)))
            for conv, more in come.items():
                floor, kept = changed.get(conv) or held.get(conv) or (None, [])
                kept = sorted({m for m in kept + more if floor is None or m[0] > floor})
                if len(kept) > self._max_messages:
                    floor = kept[-self._max_messages - 1][0]
                    kept = kept[-self._max_messages:]
                changed[conv] = floor, kept
        for conv, (floor, kept) in changed.items():
            changed[conv] = self._fitting(floor, kept)
        held |= changed
        self._held.update((version + 1, [(conv, floor, kept) for conv, (floor, kept) in held.items()]))
        yield pd.DataFrame({"conv_id": list(changed), "turns": [[t for t, _ in kept] for _, kept in changed.values()], "version": version + 1})

    def _fitting(self, floor: int | None, kept: list[tuple[int, int]]) -> tuple[int | None, list[tuple[int, int]]]:
        total, fitting = 0, []
        for turn, size in reversed(kept):
            total += size + 2
            if fitting and total > self._max_chars:
                floor = turn
                break
            fitting.append((turn, size))
        return floor, fitting[::-1]

    def close(self) -> None:
        pass


def trimmed_histories(messages: DataFrame, max_messages: int = MAX_MESSAGES, max_chars: int = MAX_HISTORY_CHARS) -> DataFrame:
    """``messages``: conv_id, turn, size (length of the message as JSON).

    A message that is not among the newest of its own batch cannot be among the
    newest of all, so a busy conversation is cut before rows are exchanged.
    """
    newest = thin(messages, lambda rows: rows.sort_values("turn").groupby("conv_id").tail(max_messages))
    return newest.withColumn("block", block_of(F.col("conv_id"))).groupBy("block").transformWithStateInPandas(
        statefulProcessor=History(max_messages, max_chars), outputStructType=HISTORY_SCHEMA,
        outputMode="Update", timeMode="None")
