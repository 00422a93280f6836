"""Conversation histories: masked message arrays, trimming, parsing, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusdesk.functions.pii import mask_pii
from corpusdesk.functions.text import strip
from corpusdesk.params import MAX_HISTORY_CHARS, MAX_MESSAGE_CHARS, MAX_MESSAGES

MESSAGES_TYPE = "array<struct<role:string,content:string,ts:string>>"


def trim_history(messages: DataFrame, key: str, turn: str, encoded: str = "encoded",
                 max_messages: int = MAX_MESSAGES, max_chars: int = MAX_HISTORY_CHARS) -> DataFrame:
    """The newest messages of each conversation that fit both limits, at least one.

    ``encoded`` is the JSON text of one message.  The size of a history is the
    sum of its messages, two characters between neighbours and two brackets.
    The count limit is applied first and in every task, so the running sum only
    ever sees ``max_messages`` rows of a conversation.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(turn))
    recent = messages.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= max_messages)
    so_far = newest.rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum(F.length(encoded) + 2).over(so_far)
    return recent.withColumn("_size", size).where((F.col("_size") <= max_chars) | (F.col("_rn") == 1)).drop("_rn", "_size")


def history_arrays(messages: DataFrame, key: str, turn: str, role: str, content: str,
                   max_messages: int | None = None) -> DataFrame:
    """(key, messages): ordered array of the masked messages of a conversation.

    The array is as long as the conversation; ``max_messages`` keeps the newest ones
    only, for callers that must bound it.
    """
    recent = messages
    if max_messages is not None:
        newest = Window.partitionBy(key).orderBy(F.desc(turn))
        recent = messages.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= max_messages)
    entry = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    gathered = recent.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("messages"))
    return gathered.withColumn("messages", F.transform("messages", lambda m: F.struct(
        m["turn"].alias("turn"), m["role"].alias("role"), mask_pii(m["content"]).alias("content"))))


def parse_history(text: Column) -> Column:
    """The stored JSON array, or an empty one when it is broken or no array."""
    usable = F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("ARRAY"))
    return F.coalesce(F.when(usable, F.from_json(text, MESSAGES_TYPE)), F.array().cast(MESSAGES_TYPE))


def message_guard(messages: DataFrame, content: str, max_chars: int = MAX_MESSAGE_CHARS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason); blank messages are dropped silently."""
    said = messages.where(strip(F.col(content)) != "")
    too_long = F.length(strip(F.col(content))) > max_chars
    return said.where(~too_long), said.where(too_long).withColumn("reason", F.lit("message too long"))
