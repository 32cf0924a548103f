"""The subpackage's queries and their SQL."""

from __future__ import annotations

from loomspark.llm import chat, crossparse, decontaminate, lsm_dedup, neighbours, pieces, quality, simhash, suffix_dedup, tokenfiles

_MODULES = (chat, crossparse, decontaminate, lsm_dedup, neighbours, pieces, quality, simhash, suffix_dedup, tokenfiles)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
