"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

A scan lists candidates of every text: assignments, access keys, hex runs and long mixed tokens. The
hashes of their values are counted by distinct repositories and owners. A value that one owner alone
holds, in fewer than SPREAD_FROM repositories, and that mixes letters and digits is live-looking; one that
several owners hold or that one has spread over its repositories is a copied example.
Spans of the three base kinds always stay; mixed tokens become spans of kind `owned` where live-looking.

Defined results: a null text counts as empty and has no spans; a null owner or repository counts as one
owner or repository of its own; repeated rows are separate documents; other columns are not read; an
empty table gives an empty table. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

KINDS = ("assign", "access", "hex", "owned")
#: Fixed values: (pattern, group that is the value).
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": (r"(AKIA[A-Z0-9]{14,})", 1),
    "hex": (r"([0-9a-f]{16,})", 1),
    "owned": (r"([A-Za-z0-9_-]{20,})", 1),
}
ASSIGNED = 12
#: Owners, and repositories of one owner, from which on a value is a copied example.
SHARED_FROM = 2
SPREAD_FROM = 3


def flags(text: Column) -> dict[str, Column]:
    """Cheap tests that hold wherever a kind can be found."""
    small = F.lower(text)
    words = [small.contains(w) for w in ("passw", "secret", "token", "apikey", "api_key")]
    digit = text.rlike("[0-9]")
    return {"assign": words[0] | words[1] | words[2] | words[3] | words[4], "access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{16}"), "owned": digit & text.rlike(PATTERNS["owned"][0])}


def candidates(text: Column) -> Column:
    """Array of (kind, i, gap, raw, value): the i-th match of a kind and the characters before it since the last."""
    arrays = []
    for at, (kind, flag) in enumerate(flags(text).items()):
        pattern, group = PATTERNS[kind]
        zipped = F.arrays_zip(
            F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("raw"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        )
        numbered = F.transform(F.filter(zipped, lambda x: x["raw"].isNotNull()), numbering(at))
        arrays.append(F.when(flag, numbered).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,raw:string,value:string>>")))
    return F.concat(*arrays)


def numbering(kind: int):
    return lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["raw"].alias("raw"), x["value"].alias("value"))


def of_kind(kind: int):
    return lambda x: x["kind"] == kind


def scan(df: DataFrame, text_col: str, owner: Column, repository: Column, keep: list[Column]) -> DataFrame:
    """One pass over the texts: rid, the columns to keep, owner, repository and the candidates found."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.monotonically_increasing_id().alias("rid"), *keep, F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), candidates(text).alias("found"))


def spans(scanned: DataFrame) -> DataFrame:
    """rid, kind, start, end, whether the value mixes letters and digits, and its distinct owners and repositories."""
    rows = scanned.select("rid", "owner", "repository", F.inline("found"))
    upto = F.sum(F.col("gap") + F.length("raw")).over(W.partitionBy("rid", "kind").orderBy("i"))
    placed = rows.withColumn("end", upto).withColumn("start", F.col("end") - F.length("raw"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    good = ((F.col("kind") == 0) & (F.length("value") >= ASSIGNED)) | F.col("kind").isin(1, 2) | ((F.col("kind") == 3) & mixed)
    placed = placed.where(good).select("rid", "kind", "start", "end", (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).alias("mixed"), F.md5("value").alias("hash"))
    owned = rows.where(good).groupBy(F.md5("value").alias("hash"), "owner", "repository").agg(F.count(F.lit(1)).alias("n"))  # one row for each holder, before it is shuffled by value alone
    counts = owned.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("owner", "repository").alias("repositories"))
    return placed.join(counts, "hash")


def verdicts(scanned: DataFrame) -> DataFrame:
    """Per rid the spans in order, each with its kind and whether it is live-looking; an example token is no span."""
    live = (F.col("owners") < SHARED_FROM) & (F.col("repositories") < SPREAD_FROM) & F.col("mixed")
    kept = spans(scanned).where((F.col("kind") < 3) | live)
    item = F.struct(F.col("start"), F.col("kind"), F.col("end"), live.alias("live"), F.col("owners"), F.col("repositories"))
    return kept.groupBy("rid").agg(F.sort_array(F.collect_list(item)).alias("items"))


def joined(items: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def report(df: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base spans counted and digested, all spans, which of them are live-looking or examples, and owners:repositories of each."""
    scanned = written(scan(df, text_col, owner, repository, [F.col(id_col).cast("bigint").alias("_id")]))
    out = scanned.select("rid", "_id").join(verdicts(scanned), "rid", "left")
    items = F.coalesce("items", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,owners:bigint,repositories:bigint>>"))
    out = out.select("_id", items.alias("items"))
    n = [F.size(F.filter("items", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    base = joined(F.filter("items", lambda x: x["kind"] < 3))
    return out.select(
        F.col("_id").alias("doc_id"), *n, F.sha2(base, 256).alias("base_sha256"), joined(F.col("items")).alias("spans"),
        joined(F.filter("items", lambda x: x["live"])).alias("live_spans"), joined(F.filter("items", lambda x: ~x["live"])).alias("example_spans"),
        F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["owners"], x["repositories"])), ",").alias("held_by"),
    )


def redact(df: DataFrame, owner: Column, repository: Column, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of a text replaced by a mark; overlapping spans become one.

    Rows whose text can hold no candidate pass through; only the others are numbered, joined and rebuilt.
    """
    columns = df.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    any_flag = None
    for flag in flags(text).values():
        any_flag = flag if any_flag is None else any_flag | flag
    row = F.struct(*(F.col(c) for c in columns)).alias("_row")
    suspects = written(scan(df.where(any_flag).withColumn("_text", text).select(row, "_text", owner.alias("_owner"), repository.alias("_repository")), "_text", F.col("_owner"), F.col("_repository"), [F.col("_row"), F.col("_text")]))
    found = suspects.select("rid", "_row", "_text").join(verdicts(suspects), "rid", "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, span: Column) -> Column:
        gap = F.substring("_text", state["at"] + 1, span["start"] - state["at"])
        grown = F.when(span["start"] >= state["at"], F.concat(state["parts"], F.array(gap, F.lit(mark)))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), grown.alias("parts"))

    whole = F.aggregate("items", start, add, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring("_text", s["at"] + 1, F.length("_text"))))
    clean = F.when(F.col("items").isNull(), F.col(f"_row.`{text_col}`")).otherwise(whole)
    rebuilt = found.select(*(clean.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in columns))
    return df.where(~any_flag).select(*columns).unionByName(rebuilt)
