"""All core queries and their SQL, by name."""

from __future__ import annotations

from quire.plans import cases, enrich, fuzzy, identifiers, linking, logs, nested, policy, records, runs, store, texts

MODULES = [nested, store, identifiers, linking, logs, texts, runs, records, enrich, policy, fuzzy, cases]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
