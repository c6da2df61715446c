"""All queries of the library outside its optional subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_nested", "queries_signal", "queries_speech", "queries_sources")


def _gathered(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"sonoframe.plans.{name}"), what)
    return found


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("SQL")
