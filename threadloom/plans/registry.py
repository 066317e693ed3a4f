"""All queries of the engine by name, and their DuckDB counterparts."""

from __future__ import annotations

from . import query_more, query_reports, query_rest, query_rows, query_stream, query_text, query_threads

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (query_rows, query_threads, query_text, query_reports, query_stream, query_more, query_rest):
    QUERIES |= _part.REGISTERED.queries
    ORACLES |= _part.REGISTERED.oracles
