"""Registered queries and their oracle SQL, grouped by topic."""

from __future__ import annotations


def all_entries():
    from urbanframe.registry import (
        aggregates, features, filters, geometry, joins, layers, maintenance, scalars, sources, styling,
    )

    queries, oracles = {}, {}
    for mod in (sources, filters, features, joins, aggregates, geometry, scalars, layers, maintenance, styling):
        for key, (query, sql) in mod.ENTRIES.items():
            if key in queries:
                raise ValueError(f"duplicate key {key}")
            queries[key] = query
            if sql is not None:
                oracles[key] = sql
    return queries, oracles
