"""Operators bound to the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

AREAS = ["zones", "times", "tables", "network", "risk", "space", "quality", "water", "products", "streams", "files"]


def _areas():
    for name in AREAS:
        yield import_module(f"pluvion.catalog.{name}")


def all_queries():
    found = {}
    for area in _areas():
        for key, fn in area.QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} registered twice")
            found[key] = fn
    return found


def all_oracles():
    found = {}
    for area in _areas():
        found.update(area.ORACLES)
    return found
