"""Queries by name, each with the SQL that an independent engine answers it with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.notices import AS_OF, BIDS_SQL, WINS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name; tables bids and wins are defined for the SQL that names them."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            own = [text for name, text in (("bids", BIDS_SQL), ("wins", WINS_SQL)) if re.search(rf"\b{name}\b", sql + ctes)]
            recursive, more = ("RECURSIVE ", ctes.removeprefix("RECURSIVE ")) if ctes.startswith("RECURSIVE ") else ("", ctes)
            parts = [*own, *([more] if more else [])]
            ORACLE[fn.__name__] = ((f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + sql).replace(":as_of", f"TIMESTAMP '{AS_OF}'")
        return fn

    return register
