"""All named queries of the engine."""

from __future__ import annotations

import importlib

from flowtide.plans.registry import ORACLES, QUERIES, QueryFn

MODULES = [
    "flow_queries",
    "vote_queries",
    "network_queries",
    "text_queries",
    "stream_queries",
    "model_queries",
]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"flowtide.plans.{name}")


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
