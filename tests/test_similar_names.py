"""Candidate pairs and clusters of names against all pairs."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from procura.operators import similarity


def score(a: str, b: str) -> float:
    """The score stated plainly, to hold the expressions against."""
    if a and b:
        inside = [c for c in a if c in b]
        value = 0.4 * SequenceMatcher(None, a, b).ratio() + 0.3 * len(set(inside)) / len({*a, *b}) + 0.3 * len(inside) / max(len(a), len(b))
    else:
        value = float(a == b)
    (pa, ea), (pb, eb) = (re.fullmatch("(?s)([^省市县区]*[省市县区])?(.*)", x).groups("") for x in (a, b))
    if pa == pb and {ea, eb} in ({e, n + e} for e in (ea, eb) for n in ("第一", "第1")):
        return max(value, 0.85)
    for x, y in ((a, b), (b, a)):
        if y.startswith(x) and re.search("采购中心|办公室|科室|部门|处室|窗口", y[len(x) :]) or y.startswith(x) and re.search("([局厅部委办]|中心)$", x):
            return max(value, 0.88)
    ranks = [{"省": 3, "县": 1, "": None}.get(p[-1:], 2) for p in (pa, pb)]
    return value * 0.85 if None not in ranks and ranks[0] != ranks[1] else value


@pytest.fixture(scope="module")
def scores(spark):
    """Scores of all pairs of some names by the expressions."""
    names = spark.createDataFrame([(x,) for x in [*some_names(), ""]], "p string")
    pairs = names.crossJoin(names.withColumnRenamed("p", "q"))
    return {(r["p"], r["q"]): r["s"] for r in pairs.repartition(8).select("p", "q", similarity.name_score(F.col("p"), F.col("q")).alias("s")).collect()}


def test_scores(scores):
    assert len(scores) > 5000
    for (p, q), s in scores.items():
        assert s == pytest.approx(score(p, q), abs=1e-12), (p, q)
    assert scores["某市医院", "某市第一医院"] >= 0.85 and scores["某市财政局", "某市财政局政府采购中心"] >= 0.88
    assert scores["某市人民医院", "某县人民医院"] < similarity.NAME_THRESHOLD


def some_names() -> list[str]:
    r = random.Random(5)
    out = []
    for _ in range(12):
        name = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice((6, 20, 40))))
        out.append(name)
        for k in (1, 2, 3, 4):
            letters = list(name)
            for at in r.sample(range(len(name)), min(k, len(name) // 4)):
                letters[at] = r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            out.append("".join(letters))
    out += ["".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(40)]
    out += ["某市财政局", "某市财政局政府采购中心", "某市第一第1医院", "某市第1第一医院", "某市第一医院", "某市医院", "局", "第一", "某市人民医院", "某县人民医院", "某市第二医院", "公司#001", "公司#012"]
    return list(dict.fromkeys(out))


def test_no_similar_pair_is_lost(spark, scores):
    names = some_names()
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "x string, i int").select("x", F.struct("i", "x").alias("o"), F.struct("i", "x").alias("label"))
    got = {tuple(r) for r in similarity.candidates(rows).collect()}
    want = {(p, q) for i, p in enumerate(names) for q in names[i + 1 :] if scores[p, q] >= similarity.NAME_THRESHOLD}
    assert len(want) > 60 and want - got == set()


def test_numbered_names_are_told_apart_by_their_spellings(spark):
    """Names that differ in their digits share spellings: the pairs that are tried grow with these, not with the names."""
    names = [f"{kind}{i:06d}" for kind in ("Customer", "Supplier") for i in range(600)]
    rows = spark.createDataFrame([(x, i, i // 600) for i, x in enumerate(names)], "x string, o int, label int")
    _, groups = similarity.spellings_of(rows)
    assert groups.count() == 400 and similarity.candidates(rows).count() == 0
    df = spark.createDataFrame(list(enumerate(names)), "k long, name string").withColumn("normal", F.col("name"))
    got = {r["cluster"]: set(r["variants"]) for r in similarity.cluster_names(df, "normal", "name", "k").collect()}
    assert set().union(*got.values()) == set(names) and sum(map(len, got.values())) == len(names) and all(len({v[0] for v in vs}) == 1 for vs in got.values())


def test_kin_reach_the_threshold(spark):
    """Any two names of one kin are similar, so that they are linked without a score."""
    r = random.Random(3)
    names = {f"{kind}{i:09d}" for kind in ("Customer", "某市客户", "某县客户") for i in r.sample(range(90_000), 300)}
    names |= {"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(200)} | {"b" * k + "".join(r.choice("ab") for _ in range(n - k)) for n in (199, 200, 201, 420) for k in (98, 99, 110) for _ in range(3)}
    rows = spark.createDataFrame([(x,) for x in sorted(names)], "x string").select("x", similarity.kin(F.col("x"), similarity.NAME_THRESHOLD).alias("kin"))
    pairs = rows.alias("a").join(rows.alias("b"), "kin").where("a.x != b.x").select("a.x", "b.x").collect()
    assert len(pairs) > 500 and all(score(p, q) >= similarity.NAME_THRESHOLD for p, q in pairs)
    assert any("县" in p for p, _ in pairs) and rows.select("kin").distinct().count() < 3 * len(names) // 4


def test_clusters_equal_greedy_merging(spark, scores):
    names = some_names()
    want, rest = {}, list(names)
    while rest:
        own, left = [rest[0]], []
        for q in rest[1:]:
            (own if any(scores[p, q] >= similarity.NAME_THRESHOLD for p in own) else left).append(q)
        want[own[0]], rest = sorted(own), left
    df = spark.createDataFrame(list(enumerate(names)), "k long, name string").withColumn("normal", F.col("name"))
    got = {r["cluster"]: r["variants"] for r in similarity.cluster_names(df, "normal", "name", "k").collect()}
    assert got == want and max(map(len, want.values())) > 4


def test_known_titles_of_a_site_and_a_month(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh ，") for _ in range(20)) for _ in range(8)]
    stored = [(r.choice(base), f"s{r.randint(0, 2)}", r.randint(0, 90)) for _ in range(60)]
    news = [(t[:-1] + r.choice("xyh"), f"s{r.randint(0, 2)}", r.randint(0, 90)) for t in base for _ in range(6)]
    frames = [spark.createDataFrame(rows, "title string, site string, day int").withColumn("at", F.timestamp_add("DAY", F.col("day"), F.to_timestamp(F.lit("2001-01-01")))) for rows in (news, stored)]
    got = {(x["title"], x["site"], x["at"].toordinal() - 730_486): x["similarity"] for x in similarity.known_titles(*frames, site="site", time="at").collect()}
    want = {}
    for title, site, day in news:
        best = max((similarity.title_similarity(title, t) for t, s, d in stored if s == site and d >= day - 30), default=0.0)
        if best >= similarity.TITLE_THRESHOLD:
            want[title, site, day] = best
    assert got == want and 5 < len(want) < len(set(news))


def test_resolved_names_equal_all_pairs(spark, scores):
    """Names against clusters: a variant is exact, any other name goes to the most similar form, or to none."""
    names = some_names()
    stored, asked = names[::2], [*names[1::2], names[0], "", "a b c", None, names[0]]
    clusters = {c: sorted(stored[i :: 9]) for i, c in enumerate("ABCDEFGHI")}
    df = spark.createDataFrame([(c, c.lower(), v) for c, v in clusters.items()], "cluster string, canonical string, variants array<string>")
    got = {r["name"]: tuple(r)[1:] for r in similarity.resolved(spark.createDataFrame([(n,) for n in asked], "name string"), df, lambda c: F.regexp_replace(c, " ", "")).collect()}
    want = {}
    for name in {n for n in asked if n is not None}:
        form = name.replace(" ", "")
        near = [(-score(form, v), c) for c, vs in clusters.items() for v in vs if score(form, v) >= similarity.NAME_THRESHOLD]
        exact = [c for c, vs in clusters.items() if name in vs]
        c, s, how = (exact[0], 1.0, "exact") if exact else (min(near)[1], -min(near)[0], "similarity") if near else (None, None, None)
        want[name] = (c, c and c.lower(), s and pytest.approx(s, abs=1e-12), how)
    assert got == want and {w[3] for w in want.values()} == {"exact", "similarity", None}


def test_resolved_against_nothing(spark):
    empty = spark.createDataFrame([], "cluster string, canonical string, variants array<string>")
    got = similarity.resolved(spark.createDataFrame([("x",), (None,)], "name string"), empty, lambda c: c).collect()
    assert [tuple(r) for r in got] == [("x", None, None, None, None)]
