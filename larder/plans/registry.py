"""Every query of the library and its SQL twin."""

from __future__ import annotations

from larder.plans import files, intake, papers, reading, stores, streams, upkeep

MODULES = [intake, files, upkeep, reading, papers, streams, stores]

QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
