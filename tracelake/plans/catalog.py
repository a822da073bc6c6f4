"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tracelake.plans import ledger_queries, relational, review_queries, text_queries

FLAGSHIP = "brief_sections"
QUERIES: dict = relational.QUERIES | text_queries.QUERIES | ledger_queries.QUERIES | review_queries.QUERIES
ORACLES: dict[str, str] = relational.ORACLES | text_queries.ORACLES | ledger_queries.ORACLES | review_queries.ORACLES
