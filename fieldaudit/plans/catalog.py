"""All named queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("characterise", "evaluate", "ranking", "inference", "similarity", "audits", "reruns", "fitting", "texts", "stored", "streams")

QUERIES, ORACLES = {}, {}
for _group in GROUPS:
    _module = import_module(f"fieldaudit.plans.{_group}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
