"""Registry of queries: name -> (Spark builder, DuckDB oracle or None).

``(spark, sf_dir)``, reads the driver's tables through the adapter and returns a DataFrame whose
double columns are rounded to 6 places at the output edge (the oracle rounds the same way).
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions.columns import round_doubles
from .oracle_sql import with_ctes

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf):
            return round_doubles(fn(spark, sf))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn
    return deco


def rsql(select: str, ctes=(), doubles=()) -> str:
    """Oracle text: shared CTEs + a select; the listed double columns are rounded to 6 places."""
    body = select
    if doubles:
        body = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in doubles) + f") FROM ({select}) q"
    return with_ctes(*ctes) + body


# --------------------------------------------------------------------------------------------
# modules that register queries
from . import q_core, q_eval, q_io, q_links, q_models, q_next, q_stats, q_stream  # noqa: E402,F401


def queries() -> dict[str, Callable]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}

