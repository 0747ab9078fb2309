"""Checks: every operator as a query over the given tables, and the same result in SQL where SQL can
express it."""

from voxsift.checks import extraction, search, tables, topics

_PARTS = (tables, extraction, search, topics)


def queries():
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
