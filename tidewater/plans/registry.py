"""All queries of the library, by name, and their DuckDB twins."""

from tidewater.plans import ais, cases, catch, finance, forms, places, rules, selections, shapes, streams  # noqa: F401
from tidewater.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
