"""All registered queries; importing this module fills the registry."""

from corpusdesk.plans import (  # noqa: F401
    q_corpus, q_desk, q_evaluate, q_mail, q_privacy, q_search, q_sources, q_sql, q_streams,
)
from corpusdesk.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
