"""Registry of the engine's queries and of the SQL they are checked against."""

from __future__ import annotations

from lexiloom.plans import queries_answers, queries_loops, queries_tables, queries_text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (queries_text, queries_tables, queries_answers, queries_loops):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
