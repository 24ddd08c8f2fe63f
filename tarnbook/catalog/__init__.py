"""Named queries on the given tables, each with the SQL that must give the same rows."""

from tarnbook.catalog import geography, matching, masters, statuses, tidying  # noqa: F401
from tarnbook.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
