"""Validation of records: arrays of (field, code), warnings, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cleaning
from .stats import n

#: Forms of links and phone numbers, kinds of notices.
URL = r"^https?://[^\s/$.?#].[^\s]*$"
PHONE = r"^(?:(?:\+?86)?1[3-9]\d{9}|0\d{2,3}-?\d{7,8}(?:-\d{1,6})?|400-?\d{3}-?\d{4})$"
KINDS = ("bidding", "win", "change")
TITLE = (5, 200)
LARGEST = 999_999_999_999


def errors(as_of: str, title="title", budget="budget_amount", dates=("publish_date", "deadline_date"), url="source_url", phone: str | None = None, confidence: str | None = None, kind: str | None = "notice_type") -> Column:
    """Array of (field, code) of the rules that a record breaks; missing columns are named None."""
    c = F.col
    far = F.add_months(F.to_date(F.lit(as_of)), 12).cast("timestamp")

    def bad(condition: Column, field: str, code: str) -> Column:
        return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))

    text = F.trim(c(title))
    rules = [
        bad(c(title).isNull() | (text == ""), title, "REQUIRED"),
        bad(F.length(text) < TITLE[0], title, "TITLE_TOO_SHORT"), bad(F.length(text) > TITLE[1], title, "TITLE_TOO_LONG"),
        bad(c(budget) < 0, budget, "BUDGET_NEGATIVE"), bad(c(budget) > LARGEST, budget, "BUDGET_TOO_LARGE"),
        *(bad(c(d) > far, d, "DATE_TOO_FAR_FUTURE") for d in dates),
        bad((F.trim(c(url)) != "") & ~F.trim(c(url)).rlike(URL), url, "INVALID_URL"),
    ]
    if phone:
        rules.append(bad((F.trim(c(phone)) != "") & ~F.regexp_replace(c(phone), r"\s", "").rlike(PHONE), phone, "INVALID_PHONE"))
    if confidence:
        rules.append(bad(~c(confidence).between(0, 1), confidence, "CONFIDENCE_OUT_OF_RANGE"))
    if kind:
        rules.append(bad(~c(kind).isin(*KINDS), kind, "INVALID_NOTICE_TYPE"))
    return F.array_compact(F.array(*rules))


def warnings(as_of: str) -> Column:
    """Codes of what is allowed but odd."""
    c, now = F.col, F.to_timestamp(F.lit(as_of))
    rules = (
        ((c("notice_type") == "win") & (F.coalesce("winner", F.lit("")) == ""), "WIN_WITHOUT_WINNER"),
        (c("budget_amount") > 10**12, "AMOUNT_HUGE"), (c("budget_amount") < 100, "AMOUNT_TINY"),
        (c("publish_date") > now, "PUBLISHED_IN_FUTURE"), (F.year("publish_date") < 2020, "PUBLISHED_LONG_AGO"),
        (c("deadline_date") < c("publish_date"), "DEADLINE_BEFORE_PUBLICATION"),
    )
    return F.array_compact(F.array(*(F.when(condition, F.lit(code)) for condition, code in rules)))


def confidence(warned: Column, weights: dict[str, float]) -> Column:
    """Filled fields by their weights, a tenth off per warning, within 0 and 1."""
    filled = sum((F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), w).otherwise(0.0) for f, w in weights.items()), F.lit(0.0))
    return F.round(F.greatest(F.least(filled - 0.1 * F.size(warned), F.lit(1.0)), F.lit(0.0)), 4)


def report(df: DataFrame, found: Column) -> DataFrame:
    """(kind, key, count): valid and invalid records, errors by field and by code, in one pass."""
    e = df.select(found.alias("e"))
    all_ = F.array(F.struct(F.lit("record").alias("kind"), F.when(F.size("e") == 0, "valid").otherwise("invalid").alias("key")))
    fields = F.transform("e", lambda x: F.struct(F.lit("field").alias("kind"), x["field"].alias("key")))
    codes = F.transform("e", lambda x: F.struct(F.lit("code").alias("kind"), x["code"].alias("key")))
    return e.select(F.inline(F.concat(all_, fields, codes))).groupBy("kind", "key").agg(n())


def checked(df: DataFrame, as_of: str, text: list[str], amount: str, days: list[str], compacted: list[str], **options) -> DataFrame:
    """Raw rows cleaned and then validated: texts cleaned, an amount and dates parsed, links and phones without blanks; adds errors and is_valid."""
    clean = {c: cleaning.clean(F.col(c)) for c in text} | {amount: cleaning.amount_text(F.col(amount))} | {c: cleaning.date_text(F.col(c)) for c in days} | {c: cleaning.compact(F.col(c)) for c in compacted}
    rows = df.withColumns(clean).withColumn("errors", errors(as_of, **options))
    return rows.withColumn("is_valid", F.size("errors") == 0)


#: Points of the fields of a schema's record and of all others together, each of which counts as much as five.
CORE_POINTS, EXTRA_POINTS = 20, 25
EXTRA = ("project_number", "region", "industry", "contact_person", "contact_phone", "deadline_date")


def quality(kind: str = "notice_type") -> Column:
    """Points of a record up to 100: title, tenderer, date, amount and description, and further fields; a winner counts for awards, and other kinds have that point."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    core = (F.length("title") > 5, said("tenderer"), F.col("publish_date").isNotNull(), F.col("budget_amount") > 0, F.length("description") > 20)
    extra = (*(said(c) for c in EXTRA), F.when(F.col(kind) == "win", said("winner")).otherwise(True))
    points = sum((F.when(x, CORE_POINTS).otherwise(0) for x in core), F.lit(0)) + sum((F.when(x, EXTRA_POINTS).otherwise(0) for x in extra), F.lit(0))
    return F.least(points, F.lit(100)).cast("bigint")
