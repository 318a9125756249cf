"""Every registered query, with SQL oracles where one can be written."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "cleaning", "ordered", "joins", "evaluation", "statistics", "learning")


def load_all():
    from . import registry

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLES
