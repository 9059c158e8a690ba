"""All registered queries of the catalog engine and their oracle SQL."""

from __future__ import annotations

from catalogspark.plans import queries_catalog, queries_change, queries_observe, queries_quality, queries_search, queries_service

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (queries_quality, queries_change, queries_search, queries_observe, queries_service, queries_catalog):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
