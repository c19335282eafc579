"""The registry of notation queries: name -> (spark, sf_dir) -> DataFrame, with DuckDB SQL beside it."""

from __future__ import annotations

from . import choices, curation, more, notation, ordered_queries, phrases, pitch, records, replays, reports, scoring, source_queries, spellings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (pitch, notation, replays, scoring, ordered_queries, curation, source_queries, more, spellings, phrases, choices, reports, records):
    QUERIES |= module.REGISTRY.queries
    ORACLES |= module.REGISTRY.oracles
