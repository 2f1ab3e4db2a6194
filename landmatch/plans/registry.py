"""All queries of the reconciliation engine by name, and their SQL twins."""

from landmatch.plans import areas, compare, dictionary, extraction, history, live, outputs, provenance, report, shapes, status  # noqa: F401  they register their queries
from landmatch.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
