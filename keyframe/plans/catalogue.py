"""All registered queries and their SQL."""

from __future__ import annotations

from . import inputs, reports, scoring, searches, similarity, sources, timeline

QUERIES: dict = {}
SQL: dict = {}
for part in (scoring, reports, timeline, similarity, sources, inputs, searches):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
