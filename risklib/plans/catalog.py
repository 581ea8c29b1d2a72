"""All registered queries and their oracles."""

from __future__ import annotations

import importlib

MODULES = ["q_features", "q_eval", "q_eda", "q_prep", "q_neighbours", "q_stream", "q_ml", "q_stages"]


def _load():
    q, s = {}, {}
    for m in MODULES:
        mod = importlib.import_module(f"risklib.plans.{m}")
        q.update(mod.Q)
        s.update(mod.SQL)
    return q, s


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
