"""Filters over notices, each a function that returns a Column predicate.

Blank strings are not nulls, keywords are literal (no pattern characters), and date ranges include both
ends unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted forms of a date in filter parameters.
DATE_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%Y-%m-%d %H:%M:%S")
SEARCHED = ("title", "description", "tenderer")


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def has_text(column: Column | str, needle: str) -> Column:
    """Case-insensitive, literal containment."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(c).contains(needle.lower())


def keywords(words: list[str], fields: tuple[str, ...] = SEARCHED) -> Column:
    """Any word in any field."""
    return any_of([has_text(f, w) for w in words for f in fields])


def between(column: str, low=None, high=None, closed: bool = True) -> Column:
    """A range whose missing ends are open; closed says whether the upper end belongs to it."""
    c, parts = F.col(column), []
    if low is not None:
        parts.append(c >= F.lit(low))
    if high is not None:
        parts.append(c <= F.lit(high) if closed else c < F.lit(high))
    return all_of(parts)


def conjunction(region: str | None = None, industry: str | None = None, status: str | None = None, dates: tuple | None = None) -> Column:
    """Equal region, industry and status within a date range."""
    parts = [F.col(c) == v for c, v in (("region", region), ("industry", industry), ("status", status)) if v]
    return all_of([*parts, *([between("publish_date", *map(stamp, dates))] if dates else [])])


def stamp(value):
    """A literal for a date parameter."""
    return None if value is None else F.to_timestamp(F.lit(str(value)))


def code_or_name(code: str, name: str, wanted: list[str]) -> Column:
    """For each wanted value: equal code, or contained in the name."""
    return any_of([(F.col(code) == w) | has_text(name, w) for w in wanted])


def is_region(text: str) -> bool:
    """Whether a text is a region's code of two, four or six digits or a Chinese name."""
    return len(text) in (2, 4, 6) if text.isdigit() else bool(re.search("[\u4e00-\u9fff]", text))


def build(params: dict, region: Callable[[str], bool] = is_region) -> Column:
    """One predicate of a parameter dictionary: kinds are joined by AND, values of a kind by OR. Unknown kinds raise ValueError.

    region tells what is a region's code or name where these are not China's.
    """
    if unknown := sorted(set(params) - PARAMETERS):
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    params = {**params, **{k: params.get(k) or params.get(other) for k, other in (("dateFrom", "publishDateFrom"), ("dateTo", "publishDateTo"))}}
    validate(params, region)
    parts = []
    if params.get("regions"):
        parts.append(code_or_name("region_code", "region_name", params["regions"]))
    if params.get("industries"):
        parts.append(code_or_name("industry_code", "industry", params["industries"]))
    if "budgetMin" in params or "budgetMax" in params:
        parts.append(between("budget_amount", params.get("budgetMin"), params.get("budgetMax")))
    if params.get("dateFrom") or params.get("dateTo"):
        low, high = (parse_date(params[k]) if params.get(k) else None for k in ("dateFrom", "dateTo"))
        parts.append(between("publish_date", low, high))
    if params.get("status"):
        parts.append(F.col("status").isin(params["status"]))
    if params.get("keyword"):
        parts.append(keywords([params["keyword"]]))
    if params.get("notice_type"):
        parts.append(F.col("notice_type") == params["notice_type"])
    parts += [has_text(c, params[c]) for c in ("tenderer", "project_name") if params.get(c)]
    return all_of(parts)


#: Kinds of filters that build() takes.
PARAMETERS = frozenset("regions industries budgetMin budgetMax dateFrom dateTo publishDateFrom publishDateTo status keyword notice_type tenderer project_name".split())


def parse_date(text: str) -> datetime:
    for form in DATE_FORMATS:
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    raise ValueError(f"no date: {text!r}")


def validate(params: dict, region: Callable[[str], bool] = is_region) -> None:
    """Raises ValueError for amounts that are none, ranges that are upside down and regions that are neither codes nor names."""
    low, high = params.get("budgetMin"), params.get("budgetMax")
    if low is not None and high is not None:
        try:
            wrong = Decimal(str(low)) > Decimal(str(high))
        except InvalidOperation:
            raise ValueError(f"no amounts: {low!r}, {high!r}") from None
        if wrong:
            raise ValueError("budgetMin exceeds budgetMax")
    for first, last in (("dateFrom", "dateTo"), ("publishDateFrom", "publishDateTo")):
        if params.get(first) and params.get(last) and parse_date(params[first]) > parse_date(params[last]):
            raise ValueError(f"{first} is after {last}")
    for given in params.get("regions") or []:
        if not isinstance(given, str) or not region(given.strip()):
            raise ValueError(f"region: {given!r}")


def analytics(start=None, end=None, regions=None, industries=None, tenderers=None, low=None, high=None) -> Column:
    """Filter of the aggregate reports: amounts half-open and never null when a bound is given."""
    parts = [F.col(c).isin(v) for c, v in (("region", regions), ("industry", industries), ("tenderer", tenderers)) if v]
    if start or end:
        parts.append(between("publish_date", stamp(start), stamp(end)))
    if low is not None or high is not None:
        parts.append(F.col("budget_amount").isNotNull() & between("budget_amount", low, high, closed=False))
    return all_of(parts)


def push(regions: Column, industries: Column, low: Column, high: Column, least_score: Column, score: Column) -> Column:
    """Filter of a push subscription, as a join condition: null lists and bounds admit all, a null budget passes."""
    amount = F.col("budget_amount")
    return all_of([
        regions.isNull() | F.array_contains(regions, F.col("region")),
        industries.isNull() | F.array_contains(industries, F.col("industry")),
        amount.isNull() | ((low.isNull() | (amount >= low)) & (high.isNull() | (amount <= high))),
        least_score.isNull() | (score.isNotNull() & (score >= least_score)),
    ])


def owned(user: int | None, is_admin: bool = False) -> Column:
    """Rows of the user, and public rows that nobody owns; nothing without a user."""
    if is_admin:
        return F.lit(True)
    return F.lit(False) if user is None else (F.col("created_by") == user) | (F.col("is_public") & F.col("created_by").isNull())


def visible(user: int | None, tenant: str | None = None, is_admin: bool = False) -> Column:
    """Own rows and all public ones of the tenant."""
    if is_admin:
        return F.lit(True)
    if user is None:
        return F.lit(False)
    seen = (F.col("created_by") == user) | F.col("is_public")
    return seen if tenant is None else seen & (F.col("tenant_id") == tenant)


def of_tenant(tenant: str | None, is_admin: bool = False) -> Column:
    if is_admin:
        return F.lit(True)
    return F.lit(False) if not tenant else F.col("tenant_id") == tenant
