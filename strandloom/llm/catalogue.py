"""The pN_ queries and, where SQL can say the same, the SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("q_pairs", "q_neighbours", "q_split", "q_copies", "q_topn", "q_pack", "q_leak", "q_abuse")


def _modules():
    for name in MODULES:
        yield importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in getattr(m, "SQL", {}).items()}
