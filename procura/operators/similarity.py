"""Similar titles and organisation names: keyed candidate pairs, verified exactly, and clusters.

Titles: a ratio of t leaves only so many bigrams of a title unmatched, so one of that many and one more of
its rarest bigrams stands in every title that is like it; no pair is lost. Names: the score leaves only so many letters of a name
unmatched, so two of that many and two more of its rarest letters stand in every name that is like it; besides
them the pairs that the naming rules bind: a name that begins with another one, and names that are equal
without their number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import written

#: Fixed values of the naming rules: first-numbers, the letters that end a place and the ranks they stand for, words of sub-units,
#: endings of offices that have sub-units, endings of complete names.
FIRST_NUMBERS = ("第一", "第1")
PLACE_ENDINGS, PLACE_RANKS = "省市县区", "3212"
SUB_UNITS = ("采购中心", "办公室", "科室", "部门", "处室", "窗口")
OFFICE_ENDINGS = ("局", "厅", "部", "委", "办", "中心")
COMPLETE_ENDINGS = ("医院", "公司", "大学", "学院", "集团", "中心", "局", "厅", "部")
NUMBERED_SCORE, SUB_UNIT_SCORE, RANK_FACTOR = 0.85, 0.88, 0.85
PUNCTUATION = "[，。！？、；：\"（）【】《》]"
TITLE_THRESHOLD = 0.85
NAME_THRESHOLD = 0.796
#: Rows of one key on either side that are paired in one group.
CHUNK = 200
#: Spellings whose first names are tried before all names are, unless all make so few pairs a name.
HEADS, PAIRS = 8, 2


def title_form(text: str) -> str:
    return re.sub(PUNCTUATION, "", re.sub(r"\s+", "", text)).lower()


def title_similarity(a: str | None, b: str | None) -> float:
    """Ratio of matching blocks of two titles without blanks and punctuation."""
    if not a or not b:
        return 0.0
    x, y = title_form(a), title_form(b)
    return 1.0 if a == b or x == y else SequenceMatcher(None, x, y).ratio()


def letters(name: Column) -> Column:
    """Distinct letters of a name that is not empty."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1))))


def place(name: Column) -> Column:
    """The beginning of a name up to its first place ending; empty if it has none."""
    return F.regexp_extract(name, f"^[^{PLACE_ENDINGS}]*[{PLACE_ENDINGS}]", 0)


def unit_of(name: Column, office: Column) -> Column:
    """Whether a name is an office's own, followed by a sub-unit or by anything where such offices have sub-units."""
    added = F.substring(name, F.length(office) + 1, F.length(name))
    return F.startswith(name, office) & (added.rlike("|".join(SUB_UNITS)) | office.rlike(f"({'|'.join(OFFICE_ENDINGS)})$"))


def name_score(a: Column, b: Column) -> Column:
    """Score of two names: weighted ratio, shared letters and contained letters, then what the naming rules say of the pair.

    The ratio of matching blocks is a vectorised function; all else is expressions. A name and the one that has a
    first-number after the same place are bound, an office and its sub-unit, too; places of different ranks part.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    n, m = F.length(a), F.length(b)
    shared = F.size(F.array_intersect(letters(a), letters(b)))
    contained = n - F.length(F.call_function("translate", a, b, F.lit("")))
    mixed = 0.4 * similarity(ratio, a, b) + 0.3 * shared / (F.size(letters(a)) + F.size(letters(b)) - shared) + 0.3 * contained / F.greatest(n, m)
    base = F.when((n > 0) & (m > 0), mixed).otherwise((n == m).cast("double"))
    places, numbers = [place(a), place(b)], f"^({'|'.join(FIRST_NUMBERS)})"
    entities = [F.substring(name, F.length(p) + 1, F.length(name)) for name, p in zip((a, b), places, strict=True)]
    has_number = [e.rlike(numbers) & (F.regexp_replace(e, numbers, "") == other) for e, other in (entities, reversed(entities))]
    ranks = [F.call_function("translate", F.right(p, F.lit(1)), F.lit(PLACE_ENDINGS), F.lit(PLACE_RANKS)) for p in places]
    bound = (places[0] == places[1]) & (has_number[0] | has_number[1])
    apart = (ranks[0] != "") & (ranks[1] != "") & (ranks[0] != ranks[1])
    return F.least(
        F.when(bound, F.greatest(base, F.lit(NUMBERED_SCORE))).when(unit_of(a, b) | unit_of(b, a), F.greatest(base, F.lit(SUB_UNIT_SCORE)))
        .when(apart, base * RANK_FACTOR).otherwise(base), F.lit(1.0),
    )


def ratio(a: str, b: str) -> float:
    """Share of the letters of both texts that are in matching blocks."""
    return SequenceMatcher(None, a, b).ratio()


def similarity(kind, a: Column, b: Column) -> Column:
    """A similarity function of two texts as a vectorised expression."""
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([kind(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def grams(column: str) -> Column:
    """Distinct bigrams of a text; a text of one letter is its own."""
    c, size = F.col(column), F.length(column)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.array_distinct(F.when(size > 0, pairs).otherwise(F.array().cast("array<string>")))


def unmatched(size: Column, letters: Column, threshold: float) -> Column:
    """Most distinct letters of a name that another one may lack, from a lower bound on the score.

    Without u of its d letters, at most n - u of n places match. The other name has n - u or n places where the
    score can be highest, and its own share of contained letters may be whole in the latter case.
    """
    def most(u: Column) -> Column:
        rest = size - u
        return 0.3 * (letters - u) / letters + F.greatest(0.8 * rest / (size + rest) + 0.3 * rest / size, 0.4 * rest / size + 0.3)

    return F.when(letters > 1, F.size(F.filter(F.sequence(F.lit(1), letters - 1), lambda u: most(u) >= threshold - 1e-9))).otherwise(0)


def keyed_names(rows: DataFrame, threshold: float) -> DataFrame:
    """x, o, label, its letters, its keys and each of them as g: every pair at or above the threshold shares a key.

    A pair shares all but `unmatched` letters of either name, so two letters are shared among the rarest unmatched + 2
    of each, by one order of letters; names that need not share two letters have single letters as keys, too.
    """
    size = F.length("x")
    each = rows.where(size > 0).select("x", "o", "label", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring("x", i, F.lit(1))))).alias("c"))
    counts = each.groupBy("c").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are letters
    listed = each.join(F.broadcast(counts), "c").groupBy("x", "o", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "c"))), lambda s: s["c"]).alias("letters"))
    out = listed.withColumn("u", unmatched(size, F.size("letters"), threshold)).withColumn("head", F.slice("letters", F.lit(1), F.col("u") + 2))
    twos = F.flatten(F.transform("head", lambda c, i: F.transform(F.slice("head", i + 2, F.size("head")), lambda d: F.concat(c, d))))
    ones = F.when(F.size("letters") - F.col("u") < 2, F.slice("letters", F.lit(1), F.col("u") + 1)).otherwise(F.array().cast("array<string>"))
    return out.select("x", "o", "label", "letters", F.concat(twos, ones).alias("keys")).select("*", F.explode("keys").alias("g"))


def ruled(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that the naming rules bind whatever their letters: sub-units, and names that differ in their numbers."""
    begin = F.substring("x", F.lit(1), F.col("i"))
    units = rows.where(F.length("x") > 1).where(F.col("x").rlike("|".join(SUB_UNITS + OFFICE_ENDINGS)))  # without any of these there is no sub-unit
    begins = units.select("x", F.explode(F.sequence(F.lit(1), F.length("x") - 1)).alias("i")).where(unit_of(F.col("x"), begin)).select(begin.alias("a"), F.col("x").alias("b"))
    bare = F.regexp_replace("x", "|".join(FIRST_NUMBERS), "")
    plain = rows.select("x", bare.alias("bare"))
    numbered = plain.where("x != bare").select(F.col("x").alias("b"), "bare").join(plain.select(F.col("x").alias("a"), "bare"), "bare").select("a", "b")
    empty = F.broadcast(rows.where("x = ''").select(F.col("x").alias("a"))).crossJoin(rows.where("x != ''").select(F.col("x").alias("b")))
    return begins.join(rows.select(F.col("x").alias("a")), "a").select("a", "b").union(numbered).union(empty)


def spelled(name: Column) -> Column:
    """The letters of a name in order, each as often as it stands there."""
    return F.when(F.length(name) > 0, F.array_join(F.sort_array(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)))), "")).otherwise("")


def most_score() -> Column:
    """The highest score of names that have the letters of p_x and q_x in any order, the distinct ones in p_own and q_own, but for what the naming rules bind."""
    n, m = F.length("p_x"), F.length("q_x")
    in_p, in_q, shared = (F.length(a) - F.length(F.call_function("translate", F.col(a), F.col(b), F.lit(""))) for a, b in (("p_x", "q_own"), ("q_x", "p_own"), ("p_own", "q_own")))
    return 0.8 * F.least(in_p, in_q) / (n + m) + 0.3 * in_p / F.greatest(n, m) + 0.3 * shared / (F.length("p_own") + F.length("q_own") - shared)


def tasks(df: DataFrame) -> int:
    """Partitions for rows that are few and take long, which Spark would put together by their size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)


def near_spellings(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of spellings (p_x, p_o, p_label, q_x, q_o, q_label) of which names may reach the threshold, with the highest score (most), p's label before q's.

    rows has x, label and o, the least and last place and number of the names of one label that have the spelling x. The
    bound on a score needs the letters alone, in no order, so names of one spelling and label share it. Rows of a key's most
    frequent label are not brought together with each other. A frequent key is dealt to tasks in chunks of either side.
    """
    keyed = written(keyed_names(rows, threshold).withColumn("own", F.array_join("letters", "")))
    counts = keyed.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(
        F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"), F.min("label").alias("first_label"), F.max("label").alias("last_label"), F.max(F.struct("n", "label"))["label"].alias("main"),
    ).where("first_label < last_label")
    dealt, own, sides = keyed.join(counts, "g"), F.pmod(F.hash("x"), "chunks"), F.sequence(F.lit(0), F.col("chunks") - 1)
    in_main = F.col("label") == F.col("main")
    ps = dealt.where("label < last_label").withColumn("chunk", own).withColumn("q_chunk", F.explode(sides)).withColumn("q_main", F.explode(F.when(in_main, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    qs = dealt.where("label > first_label").withColumn("q_chunk", own).withColumn("chunk", F.explode(sides)).withColumn("q_main", in_main)
    by = ["g", "chunk", "q_chunk", "q_main"]
    ps, qs = (df.select(*by, *(F.col(c).alias(f"{side}_{c}") for c in ("x", "o", "label", "own", "keys"))).repartition(tasks(rows), *by) for side, df in (("p", ps), ("q", qs)))
    later = (F.col("p_o.least") < F.col("q_o.last")) & (F.col("p_label") < F.col("q_label"))
    pairs = ps.join(qs, by).where(later).where(most_score() >= threshold - 1e-9).where(F.element_at(F.array_intersect("p_keys", "q_keys"), 1) == F.col("g"))
    return pairs.select("p_x", "p_o", "p_label", "q_x", "q_o", "q_label", most_score().alias("most"))


def spellings_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their spelling s, unless they have it, and the spellings of each label (x, label, o) for near_spellings."""
    spellings = rows.where("x != ''").select("x", "o", "label", "s") if "s" in rows.columns else written(rows.where("x != ''").select("x", "o", "label", spelled(F.col("x")).alias("s")))
    return spellings, written(spellings.groupBy(F.col("s").alias("x"), "label").agg(F.struct(F.min("o").alias("least"), F.max("o").alias("last"), F.count(F.lit(1)).alias("n")).alias("o")))


def first_names(spellings: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs (p, q) of a name and the first ones of those HEADS spellings that may be most like its own."""
    best = near.groupBy("q_x", "q_label").agg(F.slice(F.sort_array(F.collect_set(F.struct("most", F.col("p_o.least").alias("p"))), asc=False), 1, HEADS).alias("ps"))
    qs = spellings.select(F.col("s").alias("q_x"), F.col("label").alias("q_label"), F.col("x").alias("q"), "o")
    return qs.join(best, ["q_x", "q_label"]).select("q", "o", F.explode("ps.p").alias("p")).where("p < o").select("p.x", "q").toDF("p", "q").distinct()


def candidates(rows: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Pairs (p, q) that may reach the threshold, p before q by o and by label; none at or above it is left out.

    rows has x, o and label, both of one orderable type. Pairs share a key of keyed_names, and are left out where even
    all shared letters in their places would not do. Both are told of the spellings, of which there are far
    fewer than names where names differ in their numbers, and then brought to the names of the spellings left.
    """
    spellings, groups = spellings_of(rows)
    return names_of(rows, spellings, written(near_spellings(groups, threshold)))


def names_of(rows: DataFrame, spellings: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs (p, q) of all names of near spellings, and those that the naming rules bind."""
    near = near.select("p_x", "p_label", "q_x", "q_label")
    ps, qs = (spellings.select(F.col("s").alias(f"{c}_x"), F.col("label").alias(f"{c}_label"), F.col("x").alias(c), F.col("o").alias(f"{c}_o")) for c in "pq")
    pairs = near.join(ps, ["p_x", "p_label"]).join(qs, ["q_x", "q_label"]).where("p_o < q_o").select("p", "q")
    both = ruled(rows.select("x"))
    ends = [rows.select(F.col("x").alias(c), F.col("o").alias(f"{c}_o"), F.col("label").alias(f"{c}_label")) for c in "ab"]
    bound = both.join(ends[0], "a").join(ends[1], "b")
    swapped = F.col("a_o") > F.col("b_o")
    bound = bound.where(F.when(swapped, F.col("b_label") < F.col("a_label")).otherwise(F.col("a_label") < F.col("b_label"))).where("a_o != b_o")
    return pairs.union(bound.select(F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("p"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("q"))).distinct()


def known_titles(news: DataFrame, stored: DataFrame, threshold: float = TITLE_THRESHOLD, site: str | None = None, time: str | None = None, days: int = 30) -> DataFrame:
    """Titles of news that are like a stored one: title, stored title, similarity of the best one.

    With columns site and time, they are compared with what is stored of their own site, from `days` days before them on; both
    columns are then part of the result.

    With n and m letters and M of them matched, at most 2 (n - M) + (m - M) bigrams of a title are not in
    the other one; M >= threshold (n + m) / 2 and the shortest m bound that by `loss`. Texts without bigrams
    are like nothing but themselves.
    """
    loss = (2 - 1.5 * threshold) + (1 - 1.5 * threshold) * (threshold / (2 - threshold) if threshold > 2 / 3 else (2 - threshold) / threshold)

    def keyed(df: DataFrame, column: str) -> DataFrame:
        form = F.lower(F.regexp_replace(F.regexp_replace(F.col(column), r"(?U)\s+", ""), PUNCTUATION, ""))
        return df.where(F.col(column).isNotNull()).distinct().withColumn(f"{column}_form", form).select("*", F.explode(grams(f"{column}_form")).alias("g"))

    places, own = [site] if site else [], [c for c in (site, time) if c]
    others = stored.select(F.col("title").alias("other"), *(F.col(c).alias(f"other_{c}") for c in own))
    if time:  # the latest of the rows of a title says whether one is late enough
        others = others.groupBy("other", *(f"other_{c}" for c in places)).agg(F.max(f"other_{time}").alias("latest"))
    a, b = keyed(news.select("title", *places), "title"), keyed(others, "other")
    counts = b.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("title", *places).orderBy(F.coalesce("n", F.lit(0)), "g"))
    rare = a.join(counts, "g", "left").withColumn("place", place).where(F.col("place") <= F.floor(loss * F.length("title_form")) + 1)
    n, m = F.length("title_form"), F.length("other_form")
    pairs = rare.drop("n", "place").join(b, "g").where(2 * F.least(n, m) >= threshold * (n + m))
    if site:
        pairs = pairs.where(F.col(site) == F.col(f"other_{site}"))
    pairs = pairs.select("title", "other", *places, *(["latest"] if time else [])).distinct()
    if own:  # titles that many sites have are scored once
        pairs = written(pairs)
    scored = pairs.select("title", "other").distinct().withColumn("similarity", similarity(title_similarity, F.col("title"), F.col("other"))).where(F.col("similarity") >= threshold)
    if own:
        scored = pairs.join(scored, ["title", "other"])
    if time:
        late = F.col("latest") >= F.timestamp_add("DAY", F.lit(-days), F.col(time))
        scored = news.select("title", *own).distinct().join(scored, ["title", *places]).where(late)
    return scored.groupBy("title", *own).agg(F.max(F.struct("similarity", "other")).alias("best")).select("title", *own, "best.other", "best.similarity")


def alike(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose score reaches the threshold."""
    return written(pairs.repartition(tasks(pairs), "p", "q").where(name_score(F.col("p"), F.col("q")) >= threshold))


def kin(name: Column, threshold: float) -> Column:
    """What names have in common of which any two reach the threshold: length, distinct letters, rank of their place and beginning.

    Names of one length and the same distinct letters score 0.6 and 0.4 of their ratio, which is at least the share of a common
    beginning, since it counts the longest block. Difflib leaves out frequent letters from 200 letters on: these
    names are their own kin.
    """
    rank = F.call_function("translate", F.right(place(name), F.lit(1)), F.lit(PLACE_ENDINGS), F.lit(PLACE_RANKS))
    begin = F.floor(F.length(name) * F.greatest(F.lit((threshold - 0.6) / 0.4), F.lit(0.0)) + 1e-6).cast("int") + 1
    own = F.array_join(F.sort_array(letters(name)), "")
    return F.struct(F.length(name).alias("n"), F.when(F.length(name).between(1, 199), own).otherwise(name).alias("letters"), rank.alias("rank"), F.substring(name, F.lit(1), begin).alias("begin"))


def descended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels carried along edges (p, q): the least label of a name and of all from which edges lead to it.

    Labels with a column head have it in common with their kin, and edges lead from each name to its later kin.
    Few labels have labels less than they are and few kin differ in their labels, so what is joined is small.
    """
    kept = [c for c in labels.columns if c != "label"]
    while True:
        came = edges.join(labels.select(F.col("x").alias("p"), "label"), "p").groupBy("q").agg(F.min("label").alias("near"))
        above = labels.where("label != o").select(F.col("x").alias("r"), F.col("label").alias("above"))
        above = above.join(labels.select(F.col("label.x").alias("r")).distinct(), "r", "left_semi")
        step = labels.join(came, F.col("x") == F.col("q"), "left").join(above, F.col("label.x") == F.col("r"), "left")
        least = [F.coalesce("near", "label"), F.coalesce("above", "label")]
        if "head" in kept:
            own = labels.groupBy("head").agg(F.min(F.struct("label", "o")).alias("least"), F.max("label").alias("most")).where("least.label != most").select(F.col("head").alias("own"), "least")
            step = step.join(own, F.col("head") == F.col("own"), "left")
            least.append(F.when(F.col("least.o") < F.col("o"), F.col("least.label")).otherwise(F.col("label")))
        step = written(step.select(*kept, F.least("label", *least).alias("label"), F.col("label").alias("old")))
        changed = step.where("label != old").limit(1).count()
        labels = step.drop("old")
        if not changed:
            return labels


def cluster_names(df: DataFrame, normal: str, name: str, order: str, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Clusters of names: cluster (its first normal form), canonical, short name, variants and confidence.

    Names with one normal form are a cluster. Clusters are merged greedily in the order of their first
    appearance, a cluster growing while it is compared: a name belongs to the first name from which similar pairs
    lead to it, each from an earlier name to a later one. Pairs are scored only where they could change that, the
    nearest names first, until none is left. Merged clusters have the confidence 1 they start with.
    """
    firsts = df.where(F.col(normal).isNotNull()).groupBy(F.col(normal).alias("x")).agg(F.min(order).alias("first"), F.sort_array(F.collect_set(name)).alias("names"))
    firsts = written(firsts.select("*", kin(F.col("x"), threshold).alias("kin"), spelled(F.col("x")).alias("s")))
    rows = firsts.select("x", F.struct("first", "x").alias("o"), "kin", "s")
    heads = rows.groupBy("kin").agg(F.min("o").alias("head"))
    labels = written(rows.join(heads, "kin").select("x", "o", "head", "s"))
    tops = labels.where("o = head").select("x", "o", F.col("o").alias("label"), "s")
    spellings, groups = spellings_of(tops)
    edges = alike(first_names(spellings, near_spellings(groups, threshold)), threshold)
    tops = descended(tops, edges).select(F.col("o").alias("head"), "label")
    labels = written(labels.join(tops, "head"))
    few, whole = PAIRS * labels.count(), False
    while True:
        spellings, groups = spellings_of(labels)
        near = written(near_spellings(groups, threshold))
        whole = whole or (near.agg(F.sum(F.col("p_o.n") * F.col("q_o.n"))).first()[0] or 0) <= few
        fresh = alike(names_of(labels, spellings, near) if whole else first_names(spellings, near), threshold)
        found = fresh.limit(1).count()
        if found:
            edges = edges.union(fresh)
            labels = descended(labels, edges)
        elif whole:
            break
        whole = not found  # all pairs are tried last
    restored = F.exists("names", lambda v: v != F.col("x"))
    rows = firsts.select("x", "names", restored.alias("restored")).join(labels.select("x", F.col("label.x").alias("cluster")), "x")
    each = rows.select("cluster", "x", "restored", F.explode(F.array_union(F.array("x"), "names")).alias("v"))
    shortest, longest = F.struct(F.length("v").alias("n"), "v"), F.struct((-F.length("v")).alias("n"), "v")
    complete = F.lit(False)
    for word in COMPLETE_ENDINGS:
        complete = complete | F.endswith("v", F.lit(word))
    # canonical: the longest normal form that some variant had to be brought to, else the shortest complete name, else the longest
    found = each.groupBy("cluster").agg(
        F.min(F.when(F.col("restored") & (F.col("v") == F.col("x")), longest)).alias("form"), F.min(F.when(complete, shortest)).alias("complete"), F.min(longest).alias("longest"),
        F.min(shortest).alias("short"), F.sort_array(F.collect_set("v")).alias("variants"),
    )
    return found.select("cluster", F.coalesce("form.v", "complete.v", "longest.v").alias("canonical"), F.col("short.v").alias("short_name"), "variants", F.lit(1.0).alias("confidence"))


def resolved(names: DataFrame, clusters: DataFrame, normal: Callable[[Column], Column], threshold: float = NAME_THRESHOLD) -> DataFrame:
    """The cluster of each distinct name: name, cluster, canonical, confidence, method.

    A name that is a variant belongs to its cluster with confidence 1 (method exact), any other to the cluster of the most similar
    variant at or above the threshold (similarity), ties to the first cluster by name. Names that no cluster is like have
    nulls; a null name has no row. clusters has cluster, canonical and variants.
    """
    known = clusters.select("cluster", "canonical", F.explode("variants").alias("v")).withColumn("x", normal(F.col("v")))
    asked = written(names.where("name is not null").select("name").distinct().withColumn("x", normal(F.col("name"))))
    target = F.struct("cluster", "canonical")
    exact = known.groupBy(F.col("v").alias("name")).agg(F.min(target).alias("exact"))
    forms = written(known.groupBy("x").agg(F.min(target).alias("near")))
    other = asked.join(exact, "name", "left_anti").join(forms, "x", "left_anti").select("x").distinct()  # an equal form scores 1
    rows = other.select("x", F.lit(0).alias("o"), F.lit(0).alias("label")).union(forms.select("x", F.lit(1), F.lit(1)))
    pairs = candidates(rows, threshold).repartition(tasks(rows), "p", "q").withColumn("score", name_score(F.col("p"), F.col("q"))).where(F.col("score") >= threshold)
    best = pairs.join(forms, F.col("q") == F.col("x")).groupBy(F.col("p").alias("x")).agg(F.min(F.struct((-F.col("score")).alias("less"), "near")).alias("best"))
    found = asked.join(exact, "name", "left").join(forms, "x", "left").join(best, "x", "left")
    taken = F.coalesce("exact", "near", "best.near")
    confidence = F.when(F.coalesce("exact", "near").isNotNull(), 1.0).otherwise(-F.col("best.less"))
    method = F.when(F.col("exact").isNotNull(), "exact").when(taken.isNotNull(), "similarity")
    return found.select("name", taken["cluster"].alias("cluster"), taken["canonical"].alias("canonical"), confidence.alias("confidence"), method.alias("method"))
