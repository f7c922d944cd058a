"""All core queries by name, with the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("texts_files", "matching", "structures", "formats", "quality")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"siltstone.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"siltstone.plans.{name}").ORACLES
    return out
