"""All queries of the package, with the SQL that must give the same rows."""

from __future__ import annotations

from .queries import aggregates, history, joins, metrics, models, profiles, rowwise, serving, shrinkage, streams  # noqa: F401  (they register)
from .queries.registry import ORACLES, QUERIES

FLAGSHIP = "dom1_inseason_split"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
