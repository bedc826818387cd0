"""Registered queries over the driver's tables, and their SQL."""

from . import raster, relational, text  # noqa: F401  they register their queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
