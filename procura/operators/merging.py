"""Records of one notice from several sources or strategies brought together, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a source is trusted, and the sources that a field is best taken from.
WEIGHTS = {"api_list": 0.7, "detail_page": 0.85, "pdf": 0.95, "llm_extraction": 0.8, "fallback": 0.3}
PREFERRED = {"title": ("api_list", "detail_page", "llm_extraction"), "tenderer": ("pdf", "detail_page", "llm_extraction"), "budget_amount": ("api_list", "pdf", "detail_page"), "description": ("pdf", "detail_page", "llm_extraction"), "contact_person": ("pdf", "detail_page"), "contact_phone": ("pdf", "detail_page")}
UNKNOWN_WEIGHT, PREFERENCE = 0.5, 0.1
#: Least confidence at which a strategy's record is taken, in the order of trying.
THRESHOLDS = (("structured", 0.5), ("rules", 0.4), ("model", 0.3))


def trust(source: Column, field: str, weights=WEIGHTS, preferred=PREFERRED) -> Column:
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    more = F.when(source.isin(*preferred.get(field, ())), PREFERENCE).otherwise(0.0) if preferred.get(field) else F.lit(0.0)
    return F.least(F.coalesce(table[source], F.lit(UNKNOWN_WEIGHT)) + more, F.lit(1.0))


def all_fields(*records: Column) -> Column:
    """Names of the fields that any of some map columns has, sorted; a null map has none."""
    names = F.array().cast("array<string>")
    for record in records:
        names = F.array_union(names, F.coalesce(F.map_keys(record), F.array().cast("array<string>")))
    return F.array_sort(names)


def merged(df: DataFrame, key: str, fields: list[str], source: str = "source") -> DataFrame:
    """Per key each field from the source it is trusted most from, blanks left out; ties go to the name of the source."""
    def best(field: str) -> Column:
        filled = F.col(field).isNotNull() & (F.col(field).cast("string") != "")
        return F.max_by(F.when(filled, F.col(field)), F.when(filled, F.struct(trust(F.col(source), field), source))).alias(field)

    return df.groupBy(key).agg(*map(best, fields))


def cascade(df: DataFrame, key: str, strategy: str = "strategy", confidence: str = "confidence", thresholds=THRESHOLDS) -> DataFrame:
    """Per key the record of the first strategy that is sure enough, else the surest one."""
    place, sure = F.lit(len(thresholds)), F.lit(False)
    for i, (name, least) in enumerate(thresholds):
        place = F.when(F.col(strategy) == name, i).otherwise(place)
        sure = sure | ((F.col(strategy) == name) & (F.col(confidence) >= least))
    sure = F.coalesce(sure, F.lit(False))
    order = F.struct(sure, F.when(sure, -place).otherwise(0), F.col(confidence), -place, F.col(strategy))
    row = F.struct(*(F.col(c) for c in df.columns if c != key))
    return df.groupBy(key).agg(F.max_by(row, order).alias("r")).select(key, "r.*")
