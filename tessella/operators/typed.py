"""Typed tables: the type, unit and exact value of a cell's text, columns inferred from cells, rows as tables.

A table is stored by cell. Everything here is expressions and aggregates; a table of any size is spread by its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.numbers import canonical_decimal
from tessella.functions.text import normalised_header, stable_id

# What counts as a number, a percentage, a number with a unit.
NUMBER = r"[-+]?(?:\d+(?:,\d{3})*(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?"
WITH_UNIT = rf"^({NUMBER})\s*([A-Za-zµμ°][A-Za-z0-9µμ°/^·⋅.-]*)$"
LONGEST_CELL = 32_768
NUMERIC = ("integer", "decimal", "percentage")
EXACT = "decimal(38,18)"


def exact(text: Column) -> Column:
    """The decimal that a text is, thousands separators left out; null where it is none or has no room for it."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast(EXACT)


def typed_cell(raw: Column) -> Column:
    """struct<normalized, value_type, unit, warnings> of a cell's text.

    In this order: too long (text, with a warning), blank (missing), true or false, percentage (in points), integer or
    decimal, number with a unit, text. A number that no decimal of 38 digits holds is text.
    """
    text = F.trim(raw)
    percent, unit = F.regexp_extract(text, rf"^({NUMBER})\s*%$", 1), F.regexp_extract(text, WITH_UNIT, 2)
    number = F.when(text.rlike(f"^{NUMBER}$"), text).when(percent != "", percent).when(unit != "", F.regexp_extract(text, WITH_UNIT, 1))
    value = canonical_decimal(exact(number))
    kind = (
        F.when(F.char_length(raw) > LONGEST_CELL, "text")
        .when(raw.isNull() | (text == ""), "missing")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when(value.isNull(), "text")
        .when(percent != "", "percentage")
        .when(text.rlike(r"^[-+]?\d+(?:,\d{3})*$"), "integer")
        .otherwise("decimal")
    )
    normalized = F.when(kind == "boolean", F.lower(text)).when(kind.isin(*NUMERIC), value).when((kind == "text") & (F.char_length(raw) <= LONGEST_CELL), text)
    unit = F.when(kind == "percentage", F.lit("%")).when((kind == "decimal") & (unit != "") & ~text.rlike(f"^{NUMBER}$"), unit)
    warnings = F.when(F.char_length(raw) > LONGEST_CELL, F.array(F.lit("cell_length_limit_exceeded"))).otherwise(F.array().cast("array<string>"))
    return F.struct(normalized.alias("normalized"), kind.alias("value_type"), unit.alias("unit"), warnings.alias("warnings"))


def percent_format(number_format: Column) -> Column:
    """Whether a spreadsheet's number format shows percentages: a % that is neither quoted nor escaped."""
    bare = F.regexp_replace(F.regexp_replace(number_format, r"\\.", ""), '"[^"]*("|$)', "")
    return F.coalesce(bare.contains("%"), F.lit(False))


def column_letters(index: Column) -> Column:
    """A spreadsheet's name of a column counted from 0, up to three letters."""
    n = index
    first, second, third = F.pmod(n, F.lit(26)), F.floor(n / 26) - 1, F.floor((n - 26) / 676) - 1
    letter = lambda x: F.char((x + 65).cast("int"))
    two = F.concat(letter(F.pmod(second, F.lit(26))), letter(first))
    return F.when(n < 26, letter(first)).when(n < 702, two).otherwise(F.concat(letter(third), letter(F.pmod(F.floor(n / 26) - 1, F.lit(26))), letter(first)))


def cell_ref(source: Column, row: Column, column: Column, sheet: Column, page: Column) -> Column:
    """Sheet!B2 for spreadsheets, else p3:r1c1 with a page and csv:r1c1 without."""
    place = F.concat(F.lit(":r"), (row + 1).cast("string"), F.lit("c"), (column + 1).cast("string"))
    named = F.concat(F.coalesce(sheet, F.lit("Sheet")), F.lit("!"), column_letters(column), (row + 1).cast("string"))
    return F.when(source == "xlsx", named).when(page.isNotNull(), F.concat(F.lit("p"), page.cast("string"), place)).otherwise(F.concat(source, place))


def build_cells(tables: DataFrame, rows: str = "rows", most_rows: int = 100_000, most_columns: int = 256) -> DataFrame:
    """Cells of tables given as array<array<string>>, with table_id, source_type, sheet_name, page_number.

    Ragged rows are filled up with empty cells, warned of as "ragged_row"; rows and columns beyond the limits are cut.
    Row 0 is the header.
    """
    width = F.least(F.aggregate(F.transform(rows, F.size), F.lit(0), lambda a, x: F.greatest(a, x)), F.lit(most_columns))
    cut = tables.withColumn("_rows", F.slice(rows, 1, most_rows)).withColumn("_width", width)
    each = cut.select("table_id", "source_type", "sheet_name", "page_number", "_width", F.posexplode("_rows").alias("row_index", "_row"))
    places = F.sequence(F.lit(0), F.col("_width") - 1)
    cells = each.where("_width > 0").select("*", F.explode(places).alias("column_index"))
    ragged = F.col("column_index") >= F.size("_row")
    raw = F.coalesce(F.try_element_at("_row", F.col("column_index") + 1), F.lit(""))
    out = cells.select("table_id", "row_index", "column_index", cell_ref(F.col("source_type"), F.col("row_index"), F.col("column_index"), F.col("sheet_name"), F.col("page_number")).alias("cell_ref"), raw.alias("raw_value"), ragged.alias("_ragged"), "page_number")
    typed = out.withColumn("_t", typed_cell(F.col("raw_value")))
    warnings = F.concat(F.col("_t.warnings"), F.when(F.col("_ragged"), F.array(F.lit("ragged_row"))).otherwise(F.array().cast("array<string>")))
    return typed.select(stable_id("cell", F.col("table_id"), F.col("row_index"), F.col("column_index")).alias("id"), "table_id", "row_index", "column_index", "cell_ref", "raw_value", F.col("_t.normalized").alias("normalized_value"), F.col("_t.value_type").alias("value_type"), F.col("_t.unit").alias("unit"), "page_number", F.nullif(F.array_join(warnings, ","), F.lit("")).alias("parse_warnings"))


def infer_columns(cells: DataFrame) -> DataFrame:
    """table_id, column_index, raw_header, normalized_header, inferred_type, inferred_unit from cells.

    A column has the one type of its cells, "mixed" if they have several, "unknown" if all are missing; the header row
    doesn't count. A unit is inferred only if there is just one.
    """
    counted = (F.col("row_index") > 0) & (F.col("value_type") != "missing")
    of = cells.groupBy("table_id", "column_index").agg(
        F.max(F.when(F.col("row_index") == 0, F.col("raw_value"))).alias("raw_header"),
        F.min(F.when(counted, F.col("value_type"))).alias("_low"),
        F.max(F.when(counted, F.col("value_type"))).alias("_high"),
        F.min(F.when(counted, F.nullif(F.col("unit"), F.lit("")))).alias("_u"),
        F.max(F.when(counted, F.nullif(F.col("unit"), F.lit("")))).alias("_v"),
    )
    kind = F.when(F.col("_low").isNull(), "unknown").when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("mixed")
    return of.select("table_id", "column_index", "raw_header", normalised_header(F.col("raw_header"), F.col("column_index")).alias("normalized_header"), kind.alias("inferred_type"), F.when(F.col("_u") == F.col("_v"), F.col("_u")).alias("inferred_unit"))


def display_headers(cells: DataFrame, columns: DataFrame, most_rows: int = 16) -> DataFrame:
    """Each column's header, or where it is blank the first text among its first rows."""
    first = cells.where((F.col("row_index") < most_rows) & (F.col("value_type") == "text")).groupBy("table_id", "column_index").agg(F.min_by("raw_value", "row_index").alias("_first"))
    return columns.join(first, ["table_id", "column_index"], "left").select("table_id", "column_index", F.coalesce(F.nullif(F.trim("raw_header"), F.lit("")), "_first").alias("header"))


def row_labels(cells: DataFrame) -> DataFrame:
    return cells.where("column_index = 0").select("table_id", "row_index", F.col("raw_value").alias("row_label"))


def nested_tables(tables: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """Whole tables of a document: table fields with arrays of its columns and of its rows of cells."""
    cols = columns.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("column_index", "raw_header", "inferred_type", "inferred_unit"))).alias("columns"))
    row = cells.groupBy("table_id", "row_index").agg(F.array_sort(F.collect_list(F.struct("column_index", "raw_value", "cell_ref"))).alias("cells"))
    rows = row.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "cells"))).alias("rows"))
    return tables.withColumnRenamed("id", "table_id").join(cols, "table_id", "left").join(rows, "table_id", "left")


def cited_cells(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells as they are cited: with their column's header and inferred unit, and the header row's own cell."""
    heads = cells.where("row_index = 0").select("table_id", "column_index", F.col("cell_ref").alias("header_ref"), F.col("raw_value").alias("header_value"))
    cols = columns.select("table_id", "column_index", "raw_header", F.col("inferred_unit").alias("column_unit"))
    return cells.join(cols, ["table_id", "column_index"], "left").join(heads, ["table_id", "column_index"], "left")


def numeric_columns(cells: DataFrame) -> DataFrame:
    """Of each table the column with most rows that hold numbers; the leftmost of equals."""
    counts = cells.where((F.col("row_index") > 0) & F.col("value_type").isin(*NUMERIC)).groupBy("table_id", "column_index").agg(F.count_distinct("row_index").alias("n_rows"))
    at = Window.partitionBy("table_id").orderBy(F.desc("n_rows"), "column_index")
    return counts.withColumn("_k", F.row_number().over(at)).where("_k = 1").drop("_k")
