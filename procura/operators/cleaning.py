"""Cleaning and parsing of raw fields. What can't be parsed is null; nothing raises under ANSI mode."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters without width, and units of amounts.
ZERO_WIDTH = "[\\u200b-\\u200f\\u2028-\\u202f\\u2060\\ufeff\\u3000]"
UNITS = {"元": 1, "千": 1_000, "千元": 1_000, "万": 10_000, "万元": 10_000, "亿": 100_000_000, "亿元": 100_000_000}
CURRENCY = "[¥￥$€]|人民币|RMB|美元|欧元"
TIME_FORMS = ("yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d")


def shape(form: str) -> str:
    """What texts of a form look like, as a pattern."""
    return "^" + re.sub("[yMdHms]+", lambda m: r"\d{4}" if m[0] == "yyyy" else r"\d{1,2}", form.replace("'", "").replace(".", r"\.")) + "$"


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "&[a-zA-Z#0-9]+;", "")


def clean(c: Column) -> Column:
    """Without zero-width characters, tags and entities, white space runs as one blank; blank stays blank."""
    return F.trim(F.regexp_replace(strip_tags(F.regexp_replace(c, ZERO_WIDTH, "")), "(?U)\\s+", " "))


def cleaned_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that hold a sign of markup in any of the columns, with all of these columns cleaned."""
    signs = [F.col(c).contains("<") | F.col(c).contains(">") for c in columns]
    return df.where(F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), signs), F.lit(False))).withColumns({c: clean(F.col(c)) for c in columns})


def units() -> Column:
    return F.create_map(*(F.lit(x) for k, v in UNITS.items() for x in (k, v)))


def amount_with_unit(amount: Column, unit: Column) -> Column:
    """A number with a separate unit; an unknown unit counts as one."""
    number = F.regexp_replace(F.trim(amount.cast("string")), "[￥$,，]", "").try_cast("decimal(20,4)")
    return (number * F.coalesce(units()[F.trim(unit)], F.lit(1))).try_cast("decimal(20,2)")


def amount_text(c: Column) -> Column:
    """An amount written with currency, separators and unit; the number at the front or, without one, all digits."""
    return bound(F.trim(F.regexp_replace(c, CURRENCY, "")), amount_of)


def amount_of(bare: Column) -> Column:
    """The same without currency signs."""
    front = F.nullif(F.regexp_extract(bare, r"^([\d,.]+)", 1), F.lit(""))
    unit = F.nullif(F.regexp_extract(bare, r"^[\d,.]+\s*(亿元|万元|千元|亿|万|千)", 1), F.lit(""))
    digits = F.nullif(F.regexp_replace(bare, r"[^\d.]", ""), F.lit(""))
    number = F.coalesce(F.replace(front, F.lit(","), F.lit("")), digits).try_cast("decimal(20,4)")
    return (number * F.coalesce(units()[unit], F.lit(1))).try_cast("decimal(20,2)")


def date_text(c: Column) -> Column:
    """A date in any of the usual forms, the whole text being read."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^(\d{4})年(\d{1,2})月(\d{1,2})日.*$", "$1-$2-$3"), r"(Z|[+-]00:?00)$", ""))

    def read(t: Column) -> Column:
        """By the one form that a text looks like; a form that fails would cost an exception."""
        out = F.when(F.lit(False), F.lit(None).cast("timestamp"))
        for form in TIME_FORMS:
            out = out.when(t.rlike(shape(form)), F.try_to_timestamp(t, F.lit(form)))
        return out

    return bound(text, read)


def compact(c: Column) -> Column:
    """Without white space, as for links and phone numbers."""
    return F.regexp_replace(c, "(?U)\\s+", "")


def notice_kind(title: Column, kind: Column | None = None) -> Column:
    """bidding, win or change from the words of a title or a stated kind."""
    text = F.concat_ws(" ", title, *([kind] if kind is not None else []))
    return F.when(text.rlike("(?i)中标|成交|结果|award"), "win").when(text.rlike("(?i)变更|更正|change"), "change").otherwise("bidding")


def quantised(amount: Column) -> Column:
    """An amount with two places, halves to the even one; none counts as zero."""
    return F.bround(F.coalesce(amount, F.lit(0)), 2)


def in_english(name: Column, table: dict[str, str]) -> Column:
    """The English name of a region or industry where the table has one."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[name], name)


#: English names of regions and industries.
REGIONS_ENGLISH = {"北京": "Beijing", "上海": "Shanghai", "广州": "Guangzhou", "深圳": "Shenzhen", "浙江": "Zhejiang", "江苏": "Jiangsu", "广东": "Guangdong"}
INDUSTRIES_ENGLISH = {"IT": "IT", "信息技术": "IT", "建筑": "Construction", "医疗": "Healthcare", "教育": "Education", "金融": "Finance"}


def status_of(deadline: Column, as_of: str) -> Column:
    return F.when(deadline < F.to_timestamp(F.lit(as_of)), "expired").otherwise("active")


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def bound(value: Column, fn) -> Column:
    """fn of a value that is worked out once, however often fn names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def organisation(c: Column, suffixes: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """A normalised organisation name: no white space, brackets' contents or signs, standard suffix, full name for an alias."""
    endings, full = SUFFIXES if suffixes is None else suffixes, ALIASES if aliases is None else aliases
    name = compact(F.coalesce(c, F.lit("")))
    name = F.regexp_replace(name, "[（(].*?[）)]", "")
    name = F.regexp_replace(name, "[^\\u4e00-\\u9fa5a-zA-Z0-9]", "")
    if endings:
        last = "(" + "|".join(sorted(endings, key=len, reverse=True)) + ")$"
        standard = F.create_map(*(F.lit(x) for pair in endings.items() for x in pair))
        # the leftmost ending is the longest
        name = bound(name, lambda n: F.concat(F.regexp_replace(n, last, ""), F.coalesce(standard[F.regexp_extract(n, last, 1)], F.lit(""))))
    if full:
        pairs = F.array(*(F.struct(F.lit(alias).alias("alias"), F.lit(whole).alias("whole")) for alias, whole in full.items()))
        named = F.create_map(*(F.lit(x) for pair in full.items() for x in pair))
        name = bound(name, lambda n: F.coalesce(named[n], F.get(F.transform(F.filter(pairs, lambda p: F.contains(n, p["alias"]) & (F.length(n) < F.length(p["whole"]))), lambda p: p["whole"]), F.lit(0)), n))
    return name


#: Suffixes that have another standard form or end the search, and well-known aliases in order.
SUFFIXES = {s: s for s in "公司 有限公司 股份有限公司 集团 总公司 分公司 局 厅 部 委 办公室 中心 研究所 研究院 医院 学校 大学 学院 幼儿园 小学 中学".split()} | {"有限责任公司": "有限公司", "股份公司": "股份有限公司", "集团公司": "集团"}
ALIASES = {
    "中国移动": "中国移动通信集团有限公司", "中国移动通信": "中国移动通信集团有限公司", "移动": "中国移动通信集团有限公司",
    "中国电信": "中国电信集团有限公司", "电信": "中国电信集团有限公司",
    "中国联通": "中国联合网络通信集团有限公司", "联通": "中国联合网络通信集团有限公司",
    "北大": "北京大学", "清华": "清华大学",
}
