"""All registered queries."""

from nascent.plans import (  # noqa: F401
    board_queries,
    cluster_queries,
    panel_queries,
    score_queries,
    stream_queries,
    text_queries,
    training_queries,
)
from nascent.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
