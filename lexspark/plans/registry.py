"""All registered queries of the archive operators, and their oracles."""

from lexspark.plans import digesting, flows, pages, publishing, reads, rules, searching, upkeep, values  # noqa: F401  register their queries
from lexspark.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
