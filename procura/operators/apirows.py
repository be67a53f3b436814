"""Rows of API answers and of list pages: fields by configured paths and names, coerced, nothing lost unsaid.

A projection is a list of fields, each with its dotted paths in the order in which they are tried, its type
and what stands where there is none. A value that is there but is not of its type becomes null in its
column and stands as it was in the map `rescued` under the field's name; an answer that is no JSON, and a
place of the list that is no list, stands there under `_body` and `_list`, as a row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cleaning
from .markup import absolute


@dataclass(frozen=True)
class Field:
    """A column of the result. Kinds: text, markup (its tags go), url (made absolute), date, amount, long, double, boolean."""

    name: str
    paths: tuple[str, ...]
    kind: str = "text"
    default: object = None


CASTS = {"long": "bigint", "double": "double", "boolean": "boolean"}


def path_of(dotted: str) -> str:
    """A path of names in quotes, so that names may hold any sign but a dot or a quote."""
    return "$" + "".join(f"['{p}']" for p in dotted.split(".") if p)


def coerced(raw: Column, kind: str, page: Column | None) -> Column:
    """A text as a value of a kind, or null."""
    if kind == "markup":
        return F.trim(cleaning.strip_tags(raw))
    if kind == "url":
        link = F.trim(raw)
        return link if page is None else absolute(link, page)
    if kind == "date":
        return cleaning.date_text(F.substring(raw, 1, 19))
    if kind == "amount":
        return F.when(raw.rlike(r"\d"), cleaning.amount_text(raw))
    return raw.try_cast(CASTS[kind]) if kind in CASTS else F.trim(raw)


def answers(df: DataFrame, body: str, lists: tuple[str, ...], unwrap: str | None = "data") -> DataFrame:
    """A row for each element of the first list that stands at one of the paths: all other columns, place, item (a variant) and what could not be read.

    An element that is an object with an object under `unwrap` is that inner object.
    """
    rows = df.withColumn("__body", F.try_parse_json(body))
    found = [F.try_variant_get(F.col("__body"), path_of(p), "array<variant>") for p in lists]
    first = F.coalesce(*(F.when(F.size(x) > 0, x) for x in found), *found)
    rows = rows.withColumn("__list", first)
    fault = F.when(F.col("__body").isNull() & F.col(body).isNotNull() & (F.trim(body) != ""), F.create_map(F.lit("_body"), F.col(body)))
    fault = fault.when(F.col("__body").isNotNull() & F.col("__list").isNull(), F.create_map(F.lit("_list"), F.col(body)))
    rows = rows.withColumn("__fault", fault)
    others = [c for c in df.columns if c != body]
    items = F.when(F.col("__fault").isNotNull(), F.array(F.lit(None).cast("variant"))).otherwise(F.col("__list"))
    rows = rows.select(*others, "__fault", F.posexplode(items).alias("place", "item"))
    if unwrap:
        inner = F.try_variant_get("item", path_of(unwrap), "variant")
        rows = rows.withColumn("item", F.when(F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False)), inner).otherwise(F.col("item")))
    return rows


def projected(rows: DataFrame, fields: list[Field], page: Column | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """The fields of rows of `answers`, and `rescued`; elements without a required field are left out, faults stay."""
    others = [c for c in rows.columns if c not in ("item", "__fault")]
    said = rows.withColumn("__whole", F.col("item").isNotNull() & ~F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False)))
    for f in fields:
        texts = [F.nullif(F.try_variant_get("item", path_of(p), "string"), F.lit("")) for p in f.paths]
        said = said.withColumn(f"__raw_{f.name}", F.coalesce(*texts))
    for f in fields:
        said = said.withColumn(f"__got_{f.name}", coerced(F.col(f"__raw_{f.name}"), f.kind, page))
    lost = [F.when(F.col(f"__raw_{f.name}").isNotNull() & F.col(f"__got_{f.name}").isNull(), F.struct(F.lit(f.name).alias("key"), F.col(f"__raw_{f.name}").alias("value"))) for f in fields]
    lost.append(F.when(F.col("__whole"), F.struct(F.lit("_item").alias("key"), F.to_json("item").alias("value"))))
    rescued = F.coalesce("__fault", F.map_from_entries(F.filter(F.array(*lost), lambda x: x.isNotNull())))
    values = [(F.col(f"__got_{f.name}") if f.default is None else F.coalesce(F.when(F.col(f"__raw_{f.name}").isNull() & F.col("__fault").isNull(), F.lit(f.default)), F.col(f"__got_{f.name}"))).alias(f.name) for f in fields]
    out = said.select(*others, *values, rescued.alias("rescued"), F.col("__fault").isNotNull().alias("__bad"))
    for name in required:
        out = out.where(F.col("__bad") | (F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) != ""))
    return out.drop("__bad")


def request(channel: str, page: int, size: int = 20, word: str | None = None, start: str | None = None, end: str | None = None) -> dict:
    """What a search of a province's interface is asked with. Names are fixed values."""
    return {"channel_id": channel, "pageNo": page, "pageSize": size, "word": word, "startDateTime": start, "endDateTime": end, "isSearchForced": 0, "customFilter": {"operator": "and", "properties": []}}


# ---- list rows ----

#: Other names of fields, without their signs.
ALIASES = {"tenderer": ("purchaser", "buyer", "procurementunit", "owner"), "publishdate": ("date", "pubdate", "published"), "budgetamount": ("budget", "amount", "price"), "deadlinedate": ("deadline", "enddate", "closedate")}
#: Confidences of fields that patterns find in a page.
PATTERN_CONFIDENCE = {"publish_date": 0.85, "budget_amount": 0.8, "tenderer": 0.75, "project_number": 0.8}


def bare(name: str) -> str:
    return name.lower().replace("_", "").replace("-", "")


def kind_of(target: str) -> str:
    return "date" if "date" in target.lower() else "amount" if target in ("budget_amount", "amount", "budget") else "text"


def prefilled(df: DataFrame, fields: str, targets: tuple[str, ...], mapping: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns of a map of list-row fields as the targets of a detail record, which field each came from, and the targets still missing.

    A target takes the field of its own name, else the first of its mapped names, else one whose name, without
    signs and case, holds or is held by the target's or one of its aliases; among those the first by name.
    Blank fields count as absent, values that are not of the target's kind and amounts up to zero as missing.
    """
    filled = F.filter(F.map_entries(fields), lambda e: F.coalesce(F.trim(e["value"]) != "", F.lit(False)))
    rows = df.withColumn("__entries", filled)
    plain = lambda e: F.regexp_replace(F.lower(e["key"]), "[_-]", "")

    def rank(target: str):
        names = [bare(target), *ALIASES.get(bare(target), ())]

        def of(e: Column) -> Column:
            order = F.when(e["key"] == target, 0)
            for i, name in enumerate(mapping.get(target, ()), 1):
                order = order.when(e["key"] == name, i)
            own = plain(e)
            alike = F.lit(False)
            for n in names:
                alike = alike | (own == n)
            alike = alike | (F.contains(own, F.lit(names[0])) | F.contains(F.lit(names[0]), own)) & (own != "")
            return F.struct(order.when(alike, 1000).alias("rank"), e["key"].alias("field"), e["value"].alias("value"))

        return of

    for t in targets:
        rows = rows.withColumn(f"__{t}", F.array_min(F.filter(F.transform("__entries", rank(t)), lambda x: x["rank"].isNotNull())))
    values = {t: coerced(F.col(f"__{t}.value"), kind_of(t), None) for t in targets}
    sources = F.map_from_entries(F.filter(F.array(*(F.when(F.col(f"__{t}").isNotNull(), F.struct(F.lit(t).alias("key"), F.col(f"__{t}.field").alias("value"))) for t in targets)), lambda x: x.isNotNull()))
    empty = {t: F.coalesce(values[t] <= 0, F.lit(True)) if kind_of(t) == "amount" else F.coalesce(F.trim(values[t]) == "", F.lit(True)) if kind_of(t) == "text" else values[t].isNull() for t in targets}
    missing = F.filter(F.array(*(F.when(empty[t], t) for t in targets)), lambda x: x.isNotNull())
    return rows.select(*(c for c in df.columns if c != fields), *(v.alias(t) for t, v in values.items()), sources.alias("sources"), missing.alias("missing"))
