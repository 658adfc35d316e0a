"""Queries over the driver's tables: each binds one operator to a table that stands in for its market data."""

from __future__ import annotations

from tickloom.plans import delivery, feed, market, reference

QUERIES = {**market.QUERIES, **reference.QUERIES, **feed.QUERIES, **delivery.QUERIES}
ORACLE_SQL = {**market.ORACLE_SQL, **reference.ORACLE_SQL, **feed.ORACLE_SQL, **delivery.ORACLE_SQL}
