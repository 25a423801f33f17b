"""The queries of this package and the SQL that some of them equal."""

from __future__ import annotations

import importlib
import pkgutil

import sigframe.llm as package


def _modules():
    names = sorted(m.name for m in pkgutil.iter_modules(package.__path__) if m.name.startswith("op"))
    return [importlib.import_module(f"sigframe.llm.{n}") for n in names]


def queries() -> dict:
    found: dict = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in _modules():
        found |= getattr(module, "ORACLES", {})
    return found
