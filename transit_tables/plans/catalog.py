"""All transit queries and their SQL by name."""

from __future__ import annotations

from . import details, queries

QUERIES = queries.QUERIES | details.QUERIES
ORACLE = queries.ORACLE | details.ORACLE | details.MORE
