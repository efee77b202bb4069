"""The core's queries by name, and the SQL they are compared with."""

from __future__ import annotations

from lodestone.operators import agentic, caching, envelopes, graph, ingest, ledger, observe, orphans, predicate, search, texts
from lodestone.streaming import ledger as stream_ledger

_MODULES: tuple = (orphans, predicate, texts, search, ledger, observe, graph, ingest, caching, agentic, envelopes, stream_ledger)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
