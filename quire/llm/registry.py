"""All queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quire.llm import queries_metadata, queries_text

MODULES = [queries_metadata, queries_text]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
