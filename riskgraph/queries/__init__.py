"""Checked queries, one module per operator family."""

from __future__ import annotations

import importlib

FAMILIES = ("temporal", "entity", "clean", "quality", "drift", "evidence", "graph", "hubs", "pipelines")


def load():
    from riskgraph.queries import registry

    for name in FAMILIES:
        importlib.import_module(f"riskgraph.queries.{name}")
    return registry.QUERIES, registry.ORACLES
