"""Where queries are declared: the Spark plan and its SQL statement side by side."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def declare(plan: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is declared twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return declare


def ctes(*parts: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(parts) + "\n"
