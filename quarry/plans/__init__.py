"""Registered queries: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables; the oracle states the same rows in SQL over views named after
the tables.  A ``None`` oracle means the operator is not SQL-expressible
(Python parser / model stage) and is checked rows-only plus unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    # import for side effects (registration)
    from quarry.plans import search_plans  # noqa: F401
    for mod in ("patch_plans", "text_plans", "state_plans", "element_plans", "maintenance_plans"):
        try:
            __import__(f"quarry.plans.{mod}")
        except ModuleNotFoundError as e:  # modules are added as operators land
            if e.name != f"quarry.plans.{mod}":
                raise
    return REGISTRY
