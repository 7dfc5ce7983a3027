"""Operators for training-data preparation. Nothing outside this folder imports it."""

import importlib
import pkgutil


def plan_modules() -> list:
    """The modules of this subpackage that register queries."""
    names = [m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("plans")]
    return [importlib.import_module(f"{__name__}.{n}") for n in sorted(names)]
