"""Named queries over the survey tables."""

from __future__ import annotations

import importlib
import pkgutil

from trapline.plans.registry import REGISTRY, NamedQuery


def all_queries() -> dict[str, NamedQuery]:
    """Every registered query, in name order of the modules that define them."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.endswith("_queries")):
        importlib.import_module(f"{__name__}.{module}")
    return dict(REGISTRY)
