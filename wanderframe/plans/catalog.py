"""All queries of the library by name, with SQL for the oracle where SQL can state them."""

from __future__ import annotations

from . import behaviour, draws, hexes, inputs, mobility, relational, timelines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for module in (relational, mobility, behaviour, timelines, inputs, draws, hexes):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
