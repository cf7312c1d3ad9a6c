"""A roster of named queries, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import CTES, Views

Query = Callable[[SparkSession, str], DataFrame]


def with_ctes(body: str) -> str:
    """``body`` behind those common table expressions that it names, directly or through others."""
    wanted, front = set(), [body]
    while front:
        text = front.pop()
        for name, sql in CTES.items():
            if name not in wanted and _names(text, name):
                wanted.add(name)
                front.append(sql)
    parts = [f"{name} as ({sql})" for name, sql in CTES.items() if name in wanted]
    body = body.strip()
    if not parts:
        return body
    for head in ("with recursive ", "with "):
        if body.lower().startswith(head):
            return head + ",\n".join(parts) + ",\n" + body[len(head) :]
    return "with " + ",\n".join(parts) + "\n" + body


def _names(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b(?:from|join)\s+{name}\b", text, re.I) is not None


class Roster:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
        def add(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
            if sql is not None:
                self.oracle[name] = with_ctes(sql)
            return build

        return add
