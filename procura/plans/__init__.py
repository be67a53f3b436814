"""All queries of the library by name, and their SQL."""

from . import dashboards, matching, monitoring, opportunities, streams, texts
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "dashboards", "matching", "monitoring", "opportunities", "streams", "texts"]
