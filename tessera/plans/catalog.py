"""All registered queries: name -> (spark callable, oracle SQL or None)."""

from __future__ import annotations

import importlib

# Families in build order; each module exposes QUERIES and SQL dicts.
_FAMILIES = (
    "tessera.plans.q_curation",
    "tessera.plans.q_metrics",
    "tessera.plans.q_results",
    "tessera.plans.q_runlogs",
    "tessera.plans.q_splits",
    "tessera.plans.q_arrays",
    "tessera.plans.q_predictions",
    "tessera.plans.q_classes",
    "tessera.plans.q_flow",
    "tessera.plans.q_shape",
    "tessera.plans.q_projects",
)


def _load():
    queries, sql = {}, {}
    for name in _FAMILIES:
        mod = importlib.import_module(name)
        for k, fn in mod.QUERIES.items():
            if k in queries:
                raise ValueError(f"duplicate query name {k}")
            queries[k] = fn
        sql.update(getattr(mod, "SQL", {}))
    return queries, sql


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
