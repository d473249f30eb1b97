"""All queries of the library."""

from __future__ import annotations

from . import citations, generation, lifecycle, providers, quality, retrieval, text  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
