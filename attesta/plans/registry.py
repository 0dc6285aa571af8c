"""Registered queries and the SQL that gives the same rows.

Queries of tables.py read the driver's tables, those of fixtures.py only a few inline rows at any size. Of the former,
bm25_topk takes the first four words of each item and snapshot_integrity leaves out one document in 15; their forms in
_whole do not.
"""

from __future__ import annotations

from . import fixtures, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}
for module in (tables, fixtures):
    QUERIES |= module.QUERIES
    SQL |= module.SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
