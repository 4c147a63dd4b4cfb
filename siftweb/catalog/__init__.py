"""Registered queries: each reads the given tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ["pages", "media", "risk", "policy", "graphs", "audit", "streams", "jobs", "records"]


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"siftweb.catalog.{name}")
        part = getattr(module, attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict:
    return _collect("SQL")
