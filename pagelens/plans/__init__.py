"""Registered queries over the driver's tables and their SQL, and the plan of a whole run."""

from . import lookups, site, stored  # noqa: F401 (they register their queries)
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
