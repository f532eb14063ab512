"""Queries on the domain tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("scoring", "evidence", "review", "building", "streams", "testsets", "reports")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= getattr(import_module(f"tabulith.plans.{module}"), name)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
