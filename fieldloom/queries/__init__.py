"""Queries over the given tables, one or more for each operator, and the SQL that they are compared with."""

from . import changes, collections, documents, drafts, names, rollups, streams

MODULES = (documents, names, collections, drafts, changes, rollups, streams)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
