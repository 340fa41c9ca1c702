"""Query catalogue: key -> Spark plan (and its DuckDB oracle SQL where expressible)."""

from __future__ import annotations

import importlib

_MODULES = [
    "hotspot.plans.runout_queries",
    "hotspot.plans.count_queries",
    "hotspot.plans.frp_queries",
    "hotspot.plans.ingest_queries",
    "hotspot.plans.map_queries",
    "hotspot.plans.project_queries",
    "hotspot.plans.report_queries",
    "hotspot.plans.stream_queries",
]


def _registries():
    return [importlib.import_module(m).R for m in _MODULES]


def all_queries() -> dict:
    out: dict = {}
    for r in _registries():
        for k, v in r.queries.items():
            if k in out:
                raise KeyError(f"duplicate key {k}")
            out[k] = v
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for r in _registries():
        out.update(r.sql)
    return out
