"""All registered queries by name."""

from __future__ import annotations

import importlib

AREAS = ["speech", "scenes", "timeline", "visual", "chunks", "claims", "requests", "fleet", "logs", "text", "exports"]


def registered() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for area in AREAS:
        module = importlib.import_module(f"talkloom.plans.{area}")
        clash = found.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        found.update(module.QUERIES)
    return found
