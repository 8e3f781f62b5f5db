"""Conversations: pages, the prompt's share of history, numeric records in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import char_tokens


def page_before(messages: DataFrame, before: int | None, size: int, key: str = "id") -> DataFrame:
    """The size newest messages before a key, oldest first, with has_more: one row more is fetched to know it."""
    rows = messages if before is None else messages.where(F.col(key) < before)
    got = rows.orderBy(F.desc(key)).limit(size + 1)
    at = Window.orderBy(F.desc(key))  # over one page
    marked = got.withColumn("_k", F.row_number().over(at)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return marked.where(F.col("_k") <= size).drop("_k").orderBy(key)


def history_budget(turns: DataFrame, context: int = 4096, share: float = 0.35) -> DataFrame:
    """Turns that fit in a share of the context: the first user message always, then the newest as far as they fit.

    turns has conversation_id, turn, role, text. Whoever doesn't fit is skipped with all older ones, so the cut is a
    running sum over a window, not a fold.
    """
    tokens = char_tokens(F.col("text"))
    whole = Window.partitionBy("conversation_id")
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(whole)
    rows = turns.withColumn("tokens", tokens).withColumn("pinned", F.col("turn") == first)
    held = F.sum(F.when(F.col("pinned"), F.col("tokens")).otherwise(0)).over(whole)
    newer = F.sum(F.when(F.col("pinned"), 0).otherwise(F.col("tokens"))).over(whole.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_held", held).withColumn("_newer", newer).where(F.coalesce("pinned", F.lit(False)) | (F.col("_held") + F.col("_newer") <= int(context * share))).drop("_held", "_newer")


def numeric_records(text: Column) -> Column:
    """array<struct<date, first, second>> of records like 2025/08/14 123/456 in a text; second is 0 where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"\d{4}[/-]\d{2}[/-]\d{2}[ \t]+\d+(?:/\d+)?"), F.lit(0))
    part = lambda x, p: F.regexp_extract(x, p, 1)
    return F.transform(found, lambda x: F.struct(F.replace(part(x, r"^(\S+)"), F.lit("/"), F.lit("-")).alias("date"), part(x, r"\s(\d+)").try_cast("bigint").alias("first"), F.coalesce(part(x, r"/(\d+)$").try_cast("bigint"), F.lit(0)).alias("second")))


def largest_record(rows: DataFrame, text: str = "text", by: str = "total", *keys: str) -> DataFrame:
    """keys, date, value: the greatest record of each group by first, second or their total; the earliest date of equals."""
    value = {"first": F.col("r.first"), "second": F.col("r.second"), "total": F.col("r.first") + F.col("r.second")}[by]
    each = rows.select(*keys, F.explode(numeric_records(F.col(text))).alias("r")).select(*keys, F.col("r.date").alias("date"), value.alias("value")).where("value is not null")
    top = each.groupBy(*keys).agg(F.min(F.struct((-F.col("value")).alias("v"), "date")).alias("t"))
    return top.select(*keys, F.col("t.date").alias("date"), (-F.col("t.v")).alias("value"))


def unit_values(text: Column, unit: str) -> Column:
    """Distinct values in a unit that a text states, uncertainty with them, in order; split decimals like 0. 02 are healed."""
    whole = F.regexp_replace(text, r"(\d)\. (\d)", "$1.$2")
    flag = "" if len(unit) == 1 else "(?i)"
    name = r"(?:%|percent\b)" if unit == "%" else unit.replace(".", r"\.") + r"(?![\p{L}\p{N}])"
    found = F.regexp_extract_all(whole, F.lit(rf"{flag}(-?\d+(?:\.\d+)?(?:\s*(?:±|\+/-)\s*\d+(?:\.\d+)?)?)\s*{name}"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, 24)


def exact_years(prompt: Column) -> Column:
    """Distinct years 1800 to 2199 that a prompt names, in order."""
    return F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"\b((?:18|19|20|21)\d{2})\b"), F.lit(1)))


def year_rows(cells: DataFrame, years: list[str], entity: str | None = None) -> DataFrame:
    """table_id, row_index, year of rows that hold one of the years, and the entity in some cell; tables that don't give
    just one row per year are left out."""
    of = cells.where("row_index > 0").where(F.col("normalized_value").isin(*years)).select("table_id", "row_index", F.col("normalized_value").alias("year")).distinct()
    if entity:
        named = cells.where(F.lower("raw_value") == entity.lower()).select("table_id", "row_index").distinct()
        of = of.join(named, ["table_id", "row_index"], "left_semi")
    good = of.groupBy("table_id").agg(F.count("*").alias("_n"), F.count_distinct("year").alias("_y")).where((F.col("_n") == len(years)) & (F.col("_y") == len(years)))
    return of.join(good.select("table_id"), "table_id", "left_semi")
