"""The subpackage's queries and SQL, for the driver's entry file."""

from __future__ import annotations

from siteline.llm import decontam, infill, jaccard, linededup, lm, neighbours, packing, passages, quality, ranked, token_store, toolcalls, toxicity

MODULES = [lm, linededup, toxicity, token_store, passages, toolcalls, decontam, quality, packing, jaccard, infill, neighbours, ranked]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
