"""Opportunity scores as expressions; word lists and thresholds are parameters with the usual values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed values: (least amount, score), (least days, score).
AMOUNT_STEPS = ((10_000_000, 25.0), (5_000_000, 22.5), (1_000_000, 20.0), (500_000, 17.5), (100_000, 15.0), (50_000, 10.0), (10_000, 7.5))
DAY_STEPS = ((60, 20.0), (45, 18.0), (30, 16.0), (20, 14.0), (14, 12.0), (7, 8.0), (3, 5.0))
#: Words in a tenderer's name.
CONTESTED = ("政府", "国企", "央企", "事业单位", "公开招标", "竞争性磋商")
SHELTERED = ("邀请招标", "单一来源", "内部采购", "协议供货")
PREMIUM = ("中国移动", "中国联通", "中国电信", "国家电网", "南方电网", "中石油", "中石化", "中海油", "中铁", "中建", "中交")
GOVERNMENT = ("政府", "局", "委")
INSTITUTION = ("医院", "学校", "大学")
#: Words of a title by the industry of a user's profile.
PROFILE_WORDS = {"软件": ("软件", "开发", "系统", "平台", "应用", "程序"), "硬件": ("硬件", "设备", "服务器", "计算机", "网络"), "建筑": ("建筑", "工程", "施工", "装修", "土建"), "服务": ("服务", "咨询", "运维", "维护", "支持")}
#: Attractiveness of industry codes.
INDUSTRY_SCORES = {"F06": 90, "I65": 85, "E47": 80, "D35": 75, "G53": 70, "P83": 65, "J66": 60, "C17": 55, "A01": 50, "F51": 45}


def holds(column: Column, words) -> Column:
    """Whether any of the words stands in the text."""
    out = F.lit(False)
    for w in words:
        out = out | column.contains(w)
    return F.coalesce(out, F.lit(False))


def steps(value: Column, table, otherwise: float) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for low, score in table:
        out = out.when(value >= low, score)
    return out.otherwise(otherwise)


def amount_score(amount: Column) -> Column:
    return F.when(amount.isNull() | (amount <= 0), 0.0).otherwise(steps(amount, AMOUNT_STEPS, 5.0))


def competition_score(name: Column, contested=CONTESTED, sheltered=SHELTERED) -> Column:
    raw = 15.0 - F.when(holds(name, contested), 5.0).otherwise(0.0) + F.when(holds(name, sheltered), 5.0).otherwise(0.0)
    return F.greatest(F.least(raw, F.lit(25.0)), F.lit(0.0))


def whole_days(deadline: Column, as_of: str) -> Column:
    now = F.to_timestamp(F.lit(as_of))
    return F.floor((F.unix_seconds(deadline) - F.unix_seconds(now)) / 86400)


def timeline_score(deadline: Column, as_of: str) -> Column:
    return F.when(deadline.isNull(), 10.0).when(deadline < F.to_timestamp(F.lit(as_of)), 0.0).otherwise(steps(whole_days(deadline, as_of), DAY_STEPS, 2.0))


def relevance_score(title: Column, name: Column, industries=(), regions=(), words=PROFILE_WORDS) -> Column:
    fits = holds(F.lower(title), [w for i in industries for w in words.get(i, ())])
    near = holds(name, regions)
    return F.least(7.5 + F.when(fits, 5.0).otherwise(0.0) + F.when(near, 2.5).otherwise(0.0), F.lit(15.0))


def history_score(name: Column, premium=PREMIUM, government=GOVERNMENT, institution=INSTITUTION) -> Column:
    return F.when(holds(name, premium), 12.0).when(holds(name, government), 10.0).when(holds(name, institution), 9.0).otherwise(7.5)


def level(score: Column, high: float = 80, medium: float = 50) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def scored(df: DataFrame, as_of: str, amount: str = "budget_amount", profile: dict | None = None, **words) -> DataFrame:
    """The five factors, their total and its level."""
    c, profile = F.col, profile or {}
    factors = {
        "amount_score": amount_score(c(amount)),
        "competition_score": competition_score(c("tenderer"), **{k: v for k, v in words.items() if k in ("contested", "sheltered")}),
        "timeline_score": timeline_score(c("deadline_date"), as_of),
        "relevance_score": relevance_score(c("title"), c("tenderer"), profile.get("industries", ()), profile.get("regions", ()), words.get("profile_words", PROFILE_WORDS)),
        "history_score": history_score(c("tenderer"), **{k: v for k, v in words.items() if k in ("premium", "government", "institution")}),
    }
    out = df.withColumns(factors)
    total = c("amount_score") + c("competition_score") + c("timeline_score") + c("relevance_score") + c("history_score")
    return out.withColumn("total_score", total).withColumn("score_level", level(total))


def notes(pairs: list[tuple[Column, str]], default: str) -> Column:
    """Texts whose conditions hold, joined by a bar; the default if none does."""
    found = F.array_compact(F.array(*(F.when(cond, F.lit(text)) for cond, text in pairs)))
    return F.when(F.size(found) == 0, default).otherwise(F.array_join(found, "|"))


def recommendations(scores: DataFrame, n: int, amount: str = "budget_amount", key: str = "id") -> DataFrame:
    """The best n with reasons, actions and their priority; ties go by key."""
    c = F.col
    reasons = notes([(c("amount_score") >= 20, "large amount"), (c("timeline_score") >= 15, "ample time"), (c("competition_score") >= 15, "little competition")], "meets the basics")
    actions = notes([(c("timeline_score") < 10, "deadline is near"), (c(amount) > 10_000_000, "form a dedicated team"), (c("competition_score") < 10, "study competitors")], "prepare as usual")
    top = scores.orderBy(F.desc("total_score"), key).limit(n)
    return top.select(key, "total_score", reasons.alias("reasons"), actions.alias("actions"), F.row_number().over(W.orderBy(F.desc("total_score"), key)).cast("bigint").alias("priority"))


def attractiveness(amount: Column, deadline: Column, industry_code: Column, as_of: str, competition: Column | None = None, industries=INDUSTRY_SCORES) -> Column:
    """0 to 100: amount 40 %, days left 20 %, industry 20 %, competition 20 %."""
    value = amount.cast("double")
    some = amount.isNotNull() & (amount != 0)
    budget = F.when(some, F.least(F.lit(100.0), value / 1_000_000 * 20)).otherwise(0.0)
    days = F.date_diff(F.to_date(deadline), F.to_date(F.lit(as_of)))
    time = F.when(deadline.isNull(), 50.0).when(days < 0, 0.0).when(days < 7, 30.0).when(days < 30, 70.0).otherwise(100.0)
    table = F.create_map(*(F.lit(x) for k, v in industries.items() for x in (k, float(v))))
    industry = F.coalesce(table[industry_code], F.lit(50.0))
    by_size = F.when(~some | amount.isNull(), 50.0).when(amount > 10_000_000, 30.0).when(amount > 5_000_000, 50.0).when(amount > 1_000_000, 70.0).otherwise(90.0)
    if competition is not None:
        by_size = F.when(competition == "low", 90.0).when(competition == "medium", 60.0).when(competition == "high", 30.0).when(competition.isNull() | (competition == ""), by_size).otherwise(50.0)
    return F.round(budget * 0.4 + time * 0.2 + industry * 0.2 + by_size * 0.2, 2)


def opportunities(df: DataFrame, as_of: str, min_budget: float | None, limit: int) -> DataFrame:
    """Open biddings (of a budget, if one is given) with the largest budgets first, cut to the limit and then ordered by attractiveness."""
    open_ = df.where((F.col("notice_type") == "bidding") & F.col("status").isin("pending", "active"))
    if min_budget:
        open_ = open_.where(F.col("budget_amount") >= min_budget)
    largest = open_.orderBy(F.desc_nulls_first("budget_amount"), "id").limit(limit)
    score = attractiveness(F.col("budget_amount"), F.col("deadline_date"), F.col("industry_code"), as_of)
    return largest.withColumn("score", score).withColumn("recommendation", level(F.col("score"), 70, 50)).orderBy(F.desc("score"), "id")
