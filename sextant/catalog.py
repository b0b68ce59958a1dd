"""Registered queries of the engine and their SQL."""

from sextant.plans import graph_queries, note_queries  # noqa: F401, their queries register themselves
from sextant.plans import queries as registered


def queries() -> dict:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)
