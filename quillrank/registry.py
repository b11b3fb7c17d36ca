"""All queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from .queries import corpus, ranking, selection, text  # noqa: F401  they register themselves
from .queries.common import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
