"""All queries of the library by name, and the SQL each is checked against."""

from __future__ import annotations

from parlance.bindings import enrich, events, export, ingest, read, resolve, retrieve, streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
for part in (ingest, events, enrich, resolve, retrieve, read, export, streams):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
