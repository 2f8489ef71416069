"""All registered queries of the library (the training-data subpackage registers its own)."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans
from .plans import registry

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.endswith("_queries")):
    importlib.import_module(f"{plans.__name__}.{_module}")


def queries():
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
