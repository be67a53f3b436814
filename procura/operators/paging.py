"""Order, top rows and pages. Every order ends in a unique column, so pages never overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def slice_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of a page; past the end there are none."""
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def meta(total: int, page: int, size: int) -> dict:
    """Page facts with the page number held between the first and the last page."""
    pages = max(1, -(-total // size))
    page = min(max(page, 1), pages)
    return {"total": total, "total_pages": pages, "page": page, "has_next": page < pages, "has_previous": page > 1}


def fallback_page(df: DataFrame, order: list[Column], page, size: int) -> DataFrame:
    """Rows of a page; anything that is no number of a page there is gives the first one."""
    good = isinstance(page, int) and page >= 1 and (page == 1 or page <= meta(df.count(), page, size)["total_pages"])
    return slice_page(df, order, page if good else 1, size)


def recent(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key by an order; what can't be among them is left out before the shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def clamped_page(df: DataFrame, order: list[Column], page: int, size: int) -> tuple[DataFrame, dict]:
    """Rows and facts of a page; numbers beyond the last page give the last one. It counts the rows once."""
    facts = meta(df.count(), page, size)
    return slice_page(df, order, facts["page"], size), facts
