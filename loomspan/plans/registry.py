"""All core queries and their SQL."""

from __future__ import annotations

from loomspan.plans import catalog, context, memories, retrieval, training, usage

MODULES = [training, retrieval, catalog, usage, context, memories]


def queries() -> dict[str, training.Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
