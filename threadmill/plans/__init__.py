"""Queries over the test tables, with the SQL they are compared with."""

from __future__ import annotations

from threadmill.plans import (  # noqa: F401 - each registers its queries
    comment_queries,
    history_queries,
    join_queries,
    metric_queries,
    prompt_queries,
    sampling_queries,
    source_queries,
    text_queries,
)
from threadmill.plans import full_queries  # noqa: E402, F401 - joins the SQL of the others
from threadmill.plans.metric_queries import flagship
from threadmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
