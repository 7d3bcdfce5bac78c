"""All relational, scalar and streaming queries with their SQL."""

from __future__ import annotations

from tidemill.functions import scalar, tables
from tidemill.operators import analytic, ranges, ranks, relational, skew, sketches
from tidemill.sources import files
from tidemill.streaming import events

_PARTS = (relational, ranges, skew, ranks, analytic, sketches, scalar, tables, files, events)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
