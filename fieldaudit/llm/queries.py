"""The numbered queries and, where SQL can express them, their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("q_quality", "q_sharding", "q_decontaminate", "q_html", "q_lm", "q_mixing", "q_neardup", "q_pii", "q_substring", "q_tokens",
          "q_merkle", "q_lines", "q_crosstoken")

QUERIES, ORACLES = {}, {}
for _group in GROUPS:
    _module = import_module(f"fieldaudit.llm.{_group}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
