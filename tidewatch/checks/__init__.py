"""Registered queries, one module per operator family."""
from __future__ import annotations

import importlib
import pkgutil


def load():
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    from tidewatch.checks.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
