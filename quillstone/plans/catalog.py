"""The registry of queries for the reference operators and their SQL."""

from __future__ import annotations

from . import affixed, answers, chunks, documents, evaluation, jobs, layouts, lookups, records, registry, retrieval, walks  # noqa: F401  registers on import


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
