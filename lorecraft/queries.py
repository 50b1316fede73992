"""The queries of the learning-and-knowledge operators and their SQL, by name."""

from __future__ import annotations

from lorecraft.plans import claims, discovery, index, library, quality, retrieval, review, rules, scalars, streams, structure, tables, targets, texts, upkeep

_GROUPS = [texts.query, retrieval.query, review.query, tables.query, streams.query, discovery.query, quality.query, scalars.query, library.query, structure.query, upkeep.query, rules.query, claims.query, targets.query, index.query]
QUERIES = {name: f for group in _GROUPS for name, f in group.queries.items()}
SQL = {name: sql for group in _GROUPS for name, sql in group.sql.items()}
