"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the equivalent DuckDB query over the driver's base tables (None when the
    operator has no SQL form: it is then checked in tests instead)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


MODULES = ["q_market", "q_joins", "q_text", "q_training", "q_evaluate",
           "q_similarity", "q_portfolio", "q_clean", "q_io", "q_streaming"]


def load_all() -> None:
    """Import every query module (importing registers its queries)."""
    import importlib
    import importlib.util
    for m in MODULES:
        name = f"sigfolio.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
