"""Registered queries and, for DuckDB, SQL that says the same another way."""

from __future__ import annotations

from . import catalog, chunking, limiting, searching

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (searching, chunking, catalog, limiting):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
