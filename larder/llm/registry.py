"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["decontaminate", "quality", "near_dedup", "chat", "mixing", "substring_dedup", "secrets", "exact_dedup", "language_id", "sharding", "suffix_dedup", "lexical_search", "repair"]


def _collect(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"larder.llm.{m}"), name).items()}


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE_SQL")
