"""Every query of the library by name, with its SQL where SQL expresses it."""

from __future__ import annotations

from tidemark.plans import checks, queries, stages

QUERIES = queries.QUERIES | stages.QUERIES
ORACLES = checks.ORACLES | stages.ORACLES

__all__ = ["ORACLES", "QUERIES"]
