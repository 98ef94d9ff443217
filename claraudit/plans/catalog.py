"""Every query of the audit engine and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules that register queries: each has QUERIES (name -> callable) and SQL (name -> DuckDB text).
MODULES: tuple[str, ...] = ("claraudit.plans.q_pages", "claraudit.plans.q_findings", "claraudit.plans.q_rules", "claraudit.plans.q_geometry", "claraudit.plans.q_text", "claraudit.plans.q_stream", "claraudit.plans.q_checks", "claraudit.plans.q_extract", "claraudit.plans.q_more", "claraudit.plans.q_layout", "claraudit.plans.q_behaviour")


def all_queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for name in MODULES:
        out |= import_module(name).QUERIES
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(name).SQL
    return out
