"""Registered queries over the shared test tables, each with its SQL counterpart if it has one."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load_all() -> None:
    from steadymap.catalog import layouts  # noqa: F401
    for part in ("text", "perturbations", "planning", "results", "topics", "projections"):
        try:
            __import__(f"steadymap.catalog.{part}")
        except ModuleNotFoundError as e:
            if e.name != f"steadymap.catalog.{part}":
                raise
