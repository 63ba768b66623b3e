"""Registration of queries with their SQL."""

from __future__ import annotations

import re


def counted(sql: str) -> str:
    """count_if() as count(CASE ...), whose type is BIGINT."""
    while m := re.search(r"\bcount_if\(", sql):
        depth, k = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        sql = f"{sql[: m.start()]}count(CASE WHEN {sql[m.end() : k - 1]} THEN 1 END){sql[k:]}"
    return sql


def registry(queries: dict, oracle: dict[str, str]):
    """A decorator that registers a query under its name, with SQL where there is some."""

    def query(sql: str | None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = counted(sql)
            return f

        return add

    return query
