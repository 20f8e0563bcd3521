"""Queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from codehealth.llm import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLE_SQL)
