"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from rowmend.plans import (  # noqa: F401
    clean_queries, extract_queries, lookup_queries, name_queries, payload_queries, prepare_queries,
    set_queries, stream_queries, table_queries, time_queries,
)
from rowmend.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
