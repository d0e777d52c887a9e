"""Registered checks: each query reads the given tables, its SQL twin states the answer."""

from __future__ import annotations

import importlib

_FAMILIES = (
    "selection",
    "urls",
    "searching",
    "offers",
    "extraction",
    "lookups",
    "metrics",
    "streams",
    "searches",
    "products",
)


def load() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"offerloom.queries.{family}")
