"""All queries over the given tables, and the SQL that says the same."""

from inquiro.plans import build, lookups, reads, text  # noqa: F401  (they add their queries)
from inquiro.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
