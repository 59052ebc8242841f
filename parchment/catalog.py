"""Names of the archive queries, with their functions and DuckDB SQL."""

from __future__ import annotations

from parchment.operators import amendments, anchors, comparison, derivation, details, directory, extraction, forum, history, kinds, listing, names, orders, people, questions, records, retrieval, routing, sync, text_index, titles, upkeep, versions

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (retrieval, listing, versions, people, history, forum, extraction, upkeep, derivation, orders, questions, records, comparison, details, directory, names, amendments, text_index, anchors, titles, kinds, routing, sync):
    QUERIES |= _module.REGISTRY.queries
    ORACLES |= _module.REGISTRY.oracles
