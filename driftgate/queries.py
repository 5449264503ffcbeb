"""Named queries over the driver's tables and the SQL that each must agree with."""

from __future__ import annotations

from driftgate.plans import capture_queries, drift_queries

QUERIES = {**drift_queries.QUERIES, **capture_queries.QUERIES}
SQL = {**drift_queries.SQL, **capture_queries.SQL}
