"""All registered queries."""

from . import geo, ml, prep, statistics, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
