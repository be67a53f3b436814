"""Rule-based classes of tenderers, regions, industries and amounts; dictionaries are parameters or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import bound

from .scoring import holds

#: Suffixes of company names, in order, and what stands for them.
SUFFIXES = (("通信集团公司", ""), ("通信集团", ""), ("股份有限公司", "股份"), ("股份公司", "股份"), ("有限责任公司", ""), ("有限公司", ""), ("集团公司", ""), ("集团", ""), ("总公司", ""), ("公司", ""))
#: Kinds of tenderers and words in their names, in order.
KINDS = {
    "国有企业": ("中国移动", "中国联通", "中国电信", "中石油", "中石化", "国家电网", "南方电网", "中铁", "中建", "中交"),
    "政府": ("政府", "人民政府", "街道办", "开发区管委会", "财政局", "教育局", "卫生局"),
    "事业单位": ("医院", "学校", "大学", "研究院", "研究所", "中心"),
    "民营企业": ("腾讯", "阿里巴巴", "华为", "小米", "京东"),
}
OTHER = "其他企业"
UNKNOWN = "未知"
#: Macro-zones and their provinces.
ZONES = {
    "华北地区": ("北京", "天津", "河北", "山西", "内蒙古"),
    "华东地区": ("上海", "江苏", "浙江", "安徽", "福建", "江西", "山东"),
    "华南地区": ("广东", "广西", "海南"),
    "华中地区": ("河南", "湖北", "湖南"),
    "西南地区": ("重庆", "四川", "贵州", "云南", "西藏"),
    "西北地区": ("陕西", "甘肃", "青海", "宁夏", "新疆"),
    "东北地区": ("辽宁", "吉林", "黑龙江"),
}
#: Words of industries, in order, and the standard name.
INDUSTRIES = (
    ("信息技术", "信息传输、软件和信息技术服务业"), ("软件开发", "信息传输、软件和信息技术服务业"), ("互联网", "信息传输、软件和信息技术服务业"), ("电信", "信息传输、软件和信息技术服务业"), ("通信", "信息传输、软件和信息技术服务业"),
    ("建筑", "建筑业"), ("工程", "建筑业"), ("房地产", "房地产业"), ("制造", "制造业"), ("医疗", "卫生和社会工作"), ("教育", "教育"), ("金融", "金融业"), ("交通", "交通运输、仓储和邮政业"),
    ("能源", "电力、热力、燃气及水生产和供应业"), ("电力", "电力、热力、燃气及水生产和供应业"),
)
#: Least amounts of levels.
LEVELS = (("超大额 (>=1000万)", 10_000_000), ("大额 (100-1000万)", 1_000_000), ("中额 (10-100万)", 100_000))
SMALL = "小额 (<10万)"


def result(value: Column, normal: Column, category: Column, confidence: Column) -> Column:
    """Category and confidence; blanks are unknown with confidence 0."""
    blank = value.isNull() | (value == "")
    return F.struct(F.when(blank, "").otherwise(normal).alias("normalized"), F.when(blank, UNKNOWN).otherwise(category).alias("category"), F.when(blank, 0.0).otherwise(confidence).alias("confidence"))


def company(name: Column, suffixes=SUFFIXES) -> Column:
    """A name without its company suffixes."""
    for word, short in suffixes:
        name = F.replace(name, F.lit(word), F.lit(short))
    return F.trim(name)


def tenderer(name: Column, kinds=KINDS, suffixes=SUFFIXES, other: str = OTHER) -> Column:
    normal = company(name, suffixes)
    kind = F.when(F.lit(False), "")
    for label, words in kinds.items():
        kind = kind.when(holds(normal, words), label)
    return result(name, normal, kind.otherwise(other), F.when(kind.isNotNull(), 0.9).otherwise(0.6))


def region(name: Column, zones=ZONES, endings=("市", "省", "自治区", "地区")) -> Column:
    normal = name
    for word in endings:
        normal = F.replace(normal, F.lit(word), F.lit(""))
    normal = F.trim(normal)
    table = F.create_map(*(F.lit(x) for zone, names in zones.items() for n in names for x in (n, zone)))
    return result(name, normal, F.coalesce(table[normal], F.lit(UNKNOWN)), F.when(table[normal].isNotNull(), 0.98).otherwise(0.3))


def industry(name: Column, words=INDUSTRIES) -> Column:
    found = F.when(F.lit(False), "")
    for word, label in words:
        found = found.when(name.contains(word), label)
    return result(name, name, F.coalesce(found, F.lit(UNKNOWN)), F.when(found.isNotNull(), 0.85).otherwise(0.3))


def amount(value: Column) -> Column:
    out = F.when(F.lit(False), "")
    for label, low in LEVELS:
        out = out.when(value >= low, label)
    return F.when(value.isNull(), UNKNOWN).otherwise(out.otherwise(SMALL))


def by_keywords(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Industries of a text by counted keywords: key, industry, industry_code, confidence, keywords, secondary.

    dictionary has industry, code, weight, place (order of industries) and keywords (array, repeats count
    twice). It is a table of stated size and becomes one row, which is broadcast; every text is scored by itself
    and nothing is shuffled.
    """
    rows = dictionary.groupBy("industry").agg(F.first("code").alias("code"), F.first("weight").cast("double").alias("weight"), F.min("place").alias("place"), F.flatten(F.collect_list("keywords")).alias("keywords"))
    rows = rows.withColumn("keywords", F.transform("keywords", lambda k: F.struct(k.alias("word"), F.lower(k).alias("low"), F.greatest(F.length(k), F.lit(1)).alias("size"))))
    table = rows.agg(F.collect_list(F.struct("industry", "code", "weight", "place", "keywords")).alias("_table"))

    def hits(entry: Column) -> Column:
        low = F.col("_low")
        # most words are in no text, so they are looked for before they are counted
        here = F.filter(entry["keywords"], lambda k: F.contains(low, k["low"]))
        counted = F.transform(here, lambda k: F.struct(k["word"].alias("word"), ((F.length(low) - F.length(F.replace(low, k["low"], F.lit("")))) / k["size"]).cast("int").alias("times")))
        return F.struct(*(entry[c].alias(c) for c in ("industry", "code", "weight", "place")), F.filter(counted, lambda h: h["times"] > 0).alias("found"))

    def graded(entry: Column) -> Column:
        score = F.aggregate(entry["found"], F.lit(0.0), lambda s, h: s + h["times"] * (1.0 + F.length(h["word"]) / 10.0) * entry["weight"])
        return F.struct((-score).alias("rank"), entry["place"].alias("place"), *(entry[c].alias(c) for c in ("industry", "code", "found")))

    def confidence(entry: Column) -> Column:
        n, score = F.size(entry["found"]), -entry["rank"]
        many = F.when(n >= 4, 0.15).when(n >= 3, 0.1).when(n >= 2, 0.05).otherwise(0.0)
        return F.least(F.least(score / 3.5, F.lit(0.82)) + many + F.when(score >= 2.5, 0.03).otherwise(0.0), F.lit(1.0))

    found = F.filter(F.transform("_table", hits), lambda e: F.size(e["found"]) > 0)
    graded_all = F.array_sort(F.transform(found, graded))
    # one element a text with hits: exploding it keeps filters from working the scores out a second time
    best = bound(graded_all, lambda e: F.when(F.size(e) > 0, F.array(F.struct(F.get(e, F.lit(0)).alias("first"), F.slice(e, 2, 1_000_000).alias("others")))))
    told = df.select(key, F.lower(F.col(text)).alias("_low")).join(F.broadcast(table)).select(key, F.explode(best).alias("_best"))
    told = told.select(key, F.col("_best.first").alias("first"), F.filter("_best.others", lambda e: confidence(e) > 0.3).alias("others"), confidence(F.col("_best.first")).alias("confidence"))
    sure = F.col("confidence") > 0.5
    return told.select(
        key, F.when(sure, F.col("first.industry")).alias("industry"), F.when(sure, F.col("first.code")).alias("industry_code"), "confidence",
        F.array_join(F.transform("first.found", lambda h: h["word"]), ",").alias("keywords"), F.array_join(F.transform(F.slice("others", 1, 3), lambda e: e["industry"]), ",").alias("secondary"),
    )


def by_places(df: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """Province, city and district of a text: key, province, city, district, code, confidence.

    places has name, aliases (array), level (1 to 3), code and parent (name one level up), and place (order).
    Of each level the first place in that order whose name or alias stands in the text is taken, districts
    first; parents are filled in from the table.
    """
    names = places.select("name", "level", "code", "parent", "place", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("word"))
    # the table of stated size is one row, in order; the first word that a text has is its place
    in_order = F.struct((-F.col("level")).alias("deep"), "place", (F.col("word") != F.col("name")).alias("alias"), "word", "name", "level", "code", "parent", (F.col("word") == F.col("name")).alias("exact"))
    table = names.agg(F.array_sort(F.collect_list(in_order)).alias("_names"))
    first = F.get(F.filter("_names", lambda n: F.contains(F.col(text), n["word"])), F.lit(0))
    best = df.select(key, text).join(F.broadcast(table)).select(key, first.alias("b")).where("b is not null")
    up = places.select(F.col("name").alias("n2"), F.col("parent").alias("p2"))
    out = best.select(key, "b.name", "b.level", "b.code", "b.parent", "b.exact").join(F.broadcast(up), F.col("parent") == F.col("n2"), "left")
    level = F.col("level")
    return out.select(
        key, F.when(level == 1, F.col("name")).when(level == 2, F.col("parent")).otherwise(F.col("p2")).alias("province"),
        F.when(level == 2, F.col("name")).when(level == 3, F.col("parent")).alias("city"), F.when(level == 3, F.col("name")).alias("district"), "code",
        F.when(F.col("exact"), 0.95).otherwise(0.85).alias("confidence"),
    )
