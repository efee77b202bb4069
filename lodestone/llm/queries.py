"""Queries of this subpackage by name, and the SQL they are compared with."""

from __future__ import annotations

from lodestone.llm import p01_split, p02_quantiles, p03_looks, p04_neighbours, p06_near, p07_scans, p08_containers, p09_mix, p10_encoding

_MODULES = (p01_split, p02_quantiles, p03_looks, p04_neighbours, p06_near, p07_scans, p08_containers, p09_mix, p10_encoding)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
