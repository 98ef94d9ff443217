"""The queries and SQL of this subpackage, gathered from its modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("separator_scan", "resharding", "packing", "fingerprint_index", "mixing", "language_id", "flat_graph", "minhash_join", "token_files", "hamming_search", "importance", "kneser_ney_lm", "source_audit")


def _gather(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"claraudit.llm.{name}"), kind)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
