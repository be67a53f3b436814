"""Keyword subscriptions matched to notices."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import nfkc
from .tables import written

MATCH_TYPES = ("exact", "contains", "starts_with", "ends_with", "regex")
PER_KEYWORD = 10.0
#: Keywords that are broadcast at once, about; more are joined by shuffle, or block by block if they are patterns.
BROADCAST_KEYWORDS = 200_000


def search_text(*columns: str) -> Column:
    """Fields that are not blank, joined by a blank."""
    return F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in columns))


def keyword_form(value: Column) -> Column:
    """Compatibility form of a keyword."""
    return nfkc(value)


def pattern_fault(value: str | None) -> str | None:
    """Why the compatibility form of a text is no pattern."""
    try:
        re.compile(unicodedata.normalize("NFKC", value or ""))
    except (re.error, OverflowError, RecursionError) as fault:
        return str(fault)
    return None


def bad_patterns(keywords: DataFrame) -> DataFrame:
    """(value, fault) of the patterns among keywords that are none; they match nothing."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([pattern_fault(v) for v in values], dtype=object)

    fault = F.pandas_udf(run, "string")
    return keywords.where("match_type = 'regex' and value is not null").select("value").distinct().withColumn("fault", fault("value")).where("fault is not null")


#: Letters of a gram, lengths at which prefixes and suffixes are looked up, and what parts a text into grams, overlapping.
GRAM = 3
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)


def grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def cased(text: Column, sensitive: Column) -> Column:
    return F.when(sensitive, text).otherwise(F.lower(text))


def near(table: DataFrame, rows: int) -> DataFrame:
    """A side of a join that is broadcast while its number of rows, which has been counted, is small."""
    return F.broadcast(table) if rows <= BROADCAST_KEYWORDS else table


def both_cases(texts: DataFrame, key: str, text: str, flags: list[bool]) -> DataFrame:
    """Each text as it is and in lower case, as far as keywords ask for it."""
    return texts.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("case_sensitive"), cased(F.col(text), F.lit(f)).alias("t")) for f in flags))).alias("c")).select(key, "c.*")


#: Literals up to which each is tried on each text inside the row; beyond, they are looked up.
FEW = 200


def few_hits(texts: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """Texts with a keyword by trying all of a few literals, which are written into the plan."""
    each = F.array(*(F.struct(F.lit(r["value"]).alias("value"), F.lit(r["match_type"]).alias("match_type"), F.lit(r["case_sensitive"]).alias("case_sensitive"), F.lit(r["v"]).alias("v")) for r in words.collect()))

    def found(w: Column) -> Column:
        t, v = F.when(w["case_sensitive"], F.col(text)).otherwise(F.col("__low")), w["v"]
        return F.when(w["match_type"] == "contains", F.contains(t, v)).when(w["match_type"] == "exact", t == v).when(w["match_type"] == "starts_with", F.startswith(t, v)).otherwise(F.endswith(t, v))

    rows = texts.withColumn("__low", F.lower(F.col(text)))
    return rows.select(key, F.explode(F.filter(each, found)).alias("w")).select(key, "w.value", "w.match_type", "w.case_sensitive")


def placed_hits(texts: DataFrame, words: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Texts that are, begin with or end with a keyword: an equi-join on whole texts and on pieces of given lengths; the rest of a longer keyword is compared after it."""
    size = F.length("v")
    step = F.lit(0)
    for k in STEPS:
        step = F.when(size >= k, k).otherwise(step)
    words = words.withColumn("step", F.when(F.col("match_type") == "exact", -1).otherwise(step))
    kinds = {(r["match_type"], r["step"]) for r in words.select("match_type", "step").distinct().collect()}  # at most three kinds at sixteen lengths
    flags = [r[0] for r in words.select("case_sensitive").distinct().collect()]
    t = F.col("t")
    pieces = [F.struct(F.lit(kind).alias("match_type"), F.lit(k).alias("step"), (t if kind == "exact" else F.substring(t, 1, k) if kind == "starts_with" else F.substring(t, -k, k)).alias("piece")) for kind, k in sorted(kinds)]
    own = F.when(F.col("match_type") == "exact", F.col("v")).when(F.col("match_type") == "starts_with", F.substring("v", F.lit(1), F.col("step"))).otherwise(F.right("v", F.col("step")))
    rows = both_cases(texts, key, text, flags).select(key, "case_sensitive", "t", F.explode(F.array(*pieces)).alias("p")).select(key, "case_sensitive", "t", "p.*")
    met = rows.join(near(words.withColumn("piece", own), n), ["case_sensitive", "match_type", "step", "piece"])
    whole = F.when(F.col("match_type") == "exact", t == F.col("v")).when(F.col("match_type") == "starts_with", F.startswith(t, F.col("v"))).otherwise(F.endswith(t, F.col("v")))
    return met.where(whole).select(key, "value", "match_type", "case_sensitive")


def held_hits(texts: DataFrame, words: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Texts that contain a keyword: a keyword is looked up by the gram of it that the fewest texts have, then compared.

    Keywords shorter than a gram are their own grams.
    """
    words = words.withColumn("size", F.least(F.length("v"), F.lit(GRAM)))
    sizes = sorted(r[0] for r in words.select("size").distinct().collect())
    flags = [r[0] for r in words.select("case_sensitive").distinct().collect()]
    by_size = F.when(F.lit(False), F.array(F.lit("")))
    for k in sizes:
        by_size = by_size.when(F.col("size") == k, grams(F.col("v"), k))
    spelled = written(words.withColumn("gram", F.explode(by_size)))
    wanted = spelled.select("case_sensitive", "gram").distinct()
    of_text = F.concat(*(grams(F.col("t"), k) for k in sizes))
    rows = both_cases(texts, key, text, flags).select(key, "case_sensitive", "t", F.explode(of_text).alias("gram"))
    met = rows.select("case_sensitive", "gram").join(near(wanted, spelled.count()), ["case_sensitive", "gram"])
    counts = met.groupBy("case_sensitive", "gram").agg(F.count(F.lit(1)).alias("texts"))
    # a gram that no text has is the best of all: its keyword is in none
    rare = spelled.join(counts, ["case_sensitive", "gram"], "left").groupBy("value", "match_type", "case_sensitive", "v").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("best"))
    rare = written(rare.where("best.texts > 0").select("value", "match_type", "case_sensitive", "v", "best.gram"))
    if n <= BROADCAST_KEYWORDS:
        return rows.join(F.broadcast(rare), ["case_sensitive", "gram"]).where(F.contains("t", "v")).select(key, "value", "match_type", "case_sensitive")
    # texts are moved by their keys, not with each of their grams
    pairs = rows.select(key, "case_sensitive", "gram").join(rare, ["case_sensitive", "gram"])
    return pairs.join(texts, key).where(F.contains(cased(F.col(text), F.col("case_sensitive")), F.col("v"))).select(key, "value", "match_type", "case_sensitive")


def pattern_hits(texts: DataFrame, words: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Texts in which a pattern is found, by the rules of Python's patterns, in broadcast blocks of patterns."""
    spark = texts.sparkSession
    kind = texts.schema[key].dataType.simpleString()
    blocks = max(1, math.ceil(n / max(1, BROADCAST_KEYWORDS)))
    words = words.withColumn("block", F.pmod(F.xxhash64("value", "case_sensitive"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        held = spark.sparkContext.broadcast([(r["value"], r["form"], r["case_sensitive"]) for r in words.where(F.col("block") == block).collect()])  # about as many as the bound

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = [(v, c, re.compile(f, 0 if c else re.IGNORECASE).search) for v, f, c in held.value if pattern_fault(f) is None]
            for batch in batches:
                found = [(i, v, c) for i, t in enumerate(batch.column("t").to_pylist()) if t is not None for v, c, search in known if search(t)]
                if found:
                    at, values, flags = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(values, pa.string()), pa.array(["regex"] * len(at)), pa.array(flags, pa.bool_())], names=[key, "value", "match_type", "case_sensitive"])

        hits = texts.select(key, F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, value string, match_type string, case_sensitive boolean")
        out = hits if out is None else out.union(hits)
    return out


def keyword_hits(notices: DataFrame, keywords: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, value, match_type, case_sensitive) of every keyword in every text, both in their compatibility forms (NFKC).

    Literals are looked up, not tried: exact ones, prefixes and suffixes by equal pieces, contained ones by
    their rarest gram. Patterns are tried one by one; one that is none matches nothing, see `bad_patterns`.
    """
    texts = notices.select(key, F.col(text).alias(text)).where(F.col(text).isNotNull())
    texts = written(texts)
    plain = F.col(text).rlike(r"^\p{ASCII}*$")  # these are their own compatibility forms
    texts = texts.where(plain).unionByName(texts.where(~plain).select(key, nfkc(F.col(text)).alias(text)))
    distinct = keywords.select("value", "match_type", F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive")).where("value is not null").distinct()
    words = written(distinct.withColumn("form", keyword_form(F.col("value"))).withColumn("v", cased(F.col("form"), F.col("case_sensitive"))))
    count = {(r["match_type"], r["blank"]): r["n"] for r in words.groupBy("match_type", (F.col("v") == "").alias("blank")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    literals = sum(n for (kind, blank), n in count.items() if kind != "regex" and not blank)
    if 0 < literals <= FEW:
        parts.append(few_hits(texts, words.where("match_type in ('exact', 'contains', 'starts_with', 'ends_with') and v != ''"), key, text))
        count = {(kind, blank): n for (kind, blank), n in count.items() if kind == "regex" or blank}
    placed = sum(count.get((k, False), 0) for k in ("exact", "starts_with", "ends_with"))
    columns = ["value", "match_type", "case_sensitive", "v"]
    if placed:
        parts.append(placed_hits(texts, words.where("match_type in ('exact', 'starts_with', 'ends_with') and v != ''").select(*columns), key, text, placed))
    if count.get(("contains", False)):
        parts.append(held_hits(texts, words.where("match_type = 'contains' and v != ''").select(*columns), key, text, count["contains", False]))
    if patterns := count.get(("regex", False), 0) + count.get(("regex", True), 0):
        parts.append(pattern_hits(texts, words.where("match_type = 'regex'"), key, text, patterns))
    blank = [r for r in words.where("v = '' and match_type != 'regex'").select("value", "match_type", "case_sensitive").collect()] if any(b and k != "regex" for k, b in count) else []
    if blank:  # what is empty in its form is in every text, and is none but the empty one; of these there are as many as kinds and cases
        each = F.array(*(F.struct(F.lit(r["value"]).alias("value"), F.lit(r["match_type"]).alias("match_type"), F.lit(r["case_sensitive"]).alias("case_sensitive")) for r in blank))
        parts.append(texts.select(key, F.explode(F.filter(each, lambda w: (w["match_type"] != "exact") | (F.col(text) == ""))).alias("w")).select(key, "w.*"))
    if not parts:
        return texts.where("false").select(key, F.lit("").alias("value"), F.lit("").alias("match_type"), F.lit(False).alias("case_sensitive"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def evaluate(notices: DataFrame, keywords: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Scores of notices for subscriptions: one row for each pair with a matched keyword.

    keywords has subscription_id, value, match_type, case_sensitive, is_required and weight; what is compared
    with texts are distinct keywords, so results and their cost do not depend on who shares them.
    """
    keywords = keywords.withColumn("case_sensitive", F.coalesce("case_sensitive", F.lit(False)))
    hits = keyword_hits(notices, keywords, key, text)
    rules = keywords.groupBy("subscription_id").agg(F.collect_set(F.when(F.col("is_required"), F.col("value"))).alias("required"), F.count(F.lit(1)).alias("keywords"))
    pairs = hits.join(keywords, ["value", "match_type", "case_sensitive"])
    grouped = pairs.groupBy(key, "subscription_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("matched"), F.sum(F.col("weight") * PER_KEYWORD).alias("raw"),
        F.collect_set(F.when(F.col("is_required"), F.col("value"))).alias("have"), F.collect_set("value").alias("values"), F.count_if(~F.col("is_required")).alias("optional"),
    )
    out = grouped.join(rules, "subscription_id")
    bonus = F.when(F.col("matched") > 1, F.least(F.col("matched") * 2, F.lit(20))).otherwise(0)
    complete = F.size(F.array_except("required", "values")) == 0
    is_match = F.when(F.size("required") > 0, complete).otherwise(F.col("optional") > 0)
    score = F.least(F.col("raw") + bonus, F.lit(100.0)).cast("double")
    confidence = F.when(is_match, F.least(score / 200 + F.when(complete, 0.3).otherwise(0.0) + F.least(F.col("matched") * 0.05, F.lit(0.2)), F.lit(1.0))).otherwise(0.0)
    return out.select(key, "subscription_id", "matched", score.alias("score"), is_match.alias("is_match"), F.round(confidence, 6).alias("confidence"))


#: Most subscriptions of a user, keywords of a subscription and letters of a keyword.
LIMITS = {"subscriptions": 10, "keywords": 50, "length": 200}


def over_limits(rows: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(rule, key, found) of users and subscriptions beyond a limit. rows has username, subscription_id and value, one row a keyword."""
    per = {"subscriptions": ("username", F.count_distinct("subscription_id")), "keywords": ("subscription_id", F.count_distinct("value")), "length": ("subscription_id", F.max(F.length("value")))}
    parts = [rows.groupBy(F.col(key).alias("key")).agg(found.cast("bigint").alias("found")).where(F.col("found") > limits[rule]).select(F.lit(rule).alias("rule"), "key", "found") for rule, (key, found) in per.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
