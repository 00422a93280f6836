"""Calibrated settings, gathered in one place so that callers can override them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkParams:
    words: int = 500            # plain chunk size in words
    overlap: int = 50           # words shared by neighbouring plain chunks
    chars_per_word: int = 5     # character budget = words * chars_per_word
    article_threshold: int = 3  # accepted headings that make a text a regulation
    article_max: int = 2500     # longer article bodies are split
    article_target: int = 1800  # size aimed at when splitting
    preamble_min: int = 40      # a preamble must be longer than this
    title_window: int = 200     # characters before a heading searched for its title
    title_max: int = 90
    chapter_note_max: int = 80
    version: int = 3


@dataclass(frozen=True)
class SearchParams:
    dim: int = 1024
    top_k: int = 7
    pool: int = 50              # candidates per leg before fusion
    rrf_k: int = 60
    max_distance: float = 0.60
    intent_bonus: float = 0.003
    per_document: int = 3
    rerank_top_n: int = 20
    context_chars: int = 2500
    stem: int | None = None     # letters kept of a token; None keeps it whole


@dataclass(frozen=True)
class QueryParams:
    max_chars: int = 1200
    min_chars: int = 80
    min_confidence: float = 0.7


@dataclass(frozen=True)
class RetentionParams:
    conversation_days: int = 90
    log_days: int = 180
    incoming_days: int = 180


CHUNK = ChunkParams()
SEARCH = SearchParams()
QUERY = QueryParams()
RETENTION = RetentionParams()

MAX_UPLOAD_MB = 20
MAX_SEND_ATTEMPTS = 3
MAX_MESSAGES = 200
MAX_HISTORY_CHARS = 65536
MAX_MESSAGE_CHARS = 4000
MAX_FETCH_PER_POLL = 10
POLL_SECONDS = 30
IDLE_SECONDS = 300
ERROR_CHARS = 2000
