"""The whole registry: importing this module registers every reference query."""

from snapfold.plans import catalogue, reports  # noqa: F401
from snapfold.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
