"""All queries of the library by name, and their SQL for an independent engine."""

from __future__ import annotations

from .plans import answers, ingest
from .plans import queries as q


def queries() -> dict:
    return {name: run for name, (run, _) in (q.REGISTRY | ingest.REGISTRY | answers.REGISTRY).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (q.REGISTRY | ingest.REGISTRY | answers.REGISTRY).items() if sql}
