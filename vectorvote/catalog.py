"""Query callables and DuckDB SQL for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from .plans.queries import QUERIES
from .plans.sql import ORACLE


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
