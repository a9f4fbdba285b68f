"""Named queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from spindrift.plans import exploring, reporting, retrieval

PARTS = (retrieval, reporting, exploring)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
