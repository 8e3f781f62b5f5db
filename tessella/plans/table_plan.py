"""Table plans: a closed language of operations over typed tables, validated before it runs, compiled to DataFrames.

A plan names tables, or none for all of them: it then runs over every table at once and answers for each. What can't
be answered is a row with a status, not an exception: one table's mixed units don't stop the others.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.numbers import canonical_decimal
from tessella.operators.typed import EXACT, NUMERIC

# The operations, predicates and bounds of the language.
OPERATIONS = ("lookup", "filter", "sort", "group", "min", "max", "sum", "mean", "count", "compare", "difference", "percentage")
PREDICATES = ("eq", "ne", "gt", "gte", "lt", "lte", "contains")
AGGREGATES = ("count", "sum", "mean", "min", "max")
MOST_TABLES, MOST_COLUMN, MOST_RESULTS = 16, 255, 24
#: Cells that an answer cites at most; how many there are stands beside them.
MOST_REFS = 10_000
TABLE_ID = re.compile(r"tbl-[a-f0-9]{24}")


class UnsafePlan(ValueError):
    """A plan outside the language."""


@dataclass(frozen=True)
class Predicate:
    column: int
    operator: str
    value: str
    unit: str | None = None

    def __post_init__(self) -> None:
        if self.operator not in PREDICATES:
            raise UnsafePlan(f"unknown predicate {self.operator}")
        if not 0 <= self.column <= MOST_COLUMN:
            raise UnsafePlan("column out of range")


@dataclass(frozen=True)
class TablePlan:
    operation: str
    tables: tuple[str, ...] = ()
    filters: tuple[Predicate, ...] = ()
    value_column: int | None = None
    group_column: int | None = None
    aggregate: str | None = None
    direction: str = "asc"
    limit: int = MOST_RESULTS
    operands: tuple[str, ...] = ()
    search: str | None = None
    unit: str | None = None

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise UnsafePlan(f"unknown operation {self.operation}")
        if len(self.tables) > MOST_TABLES or any(not TABLE_ID.fullmatch(t) for t in self.tables):
            raise UnsafePlan("too many tables, or a table id of another form")
        if any(c is not None and not 0 <= c <= MOST_COLUMN for c in (self.value_column, self.group_column)):
            raise UnsafePlan("column out of range")
        if self.direction not in ("asc", "desc") or not 1 <= self.limit <= MOST_RESULTS:
            raise UnsafePlan("direction or limit out of range")
        if self.aggregate is not None and self.aggregate not in AGGREGATES:
            raise UnsafePlan(f"unknown aggregate {self.aggregate}")
        if self.operation in ("sort", "min", "max", "sum", "mean") and self.value_column is None:
            raise UnsafePlan("value column required")
        if self.operation == "group" and (self.group_column is None or (self.aggregate not in (None, "count") and self.value_column is None)):
            raise UnsafePlan("group or value column required")
        if self.operation in ("compare", "difference", "percentage") and len(self.operands) != 2:
            raise UnsafePlan("two operands required")

    @classmethod
    def parse(cls, payload: Mapping[str, Any]) -> TablePlan:
        """A plan from plain data. Keys that the language lacks are refused."""
        known = {f.name for f in fields(cls)}
        if extra := set(payload) - known:
            raise UnsafePlan(f"unknown keys {sorted(extra)}")
        data = dict(payload)
        try:
            data["filters"] = tuple(x if isinstance(x, Predicate) else Predicate(**x) for x in data.get("filters", ()))
            for k in ("tables", "operands"):
                data[k] = tuple(data.get(k, ()))
            return cls(**data)
        except TypeError as e:
            raise UnsafePlan(str(e)) from e


def has_unit(cell_unit: Column, raw: Column, unit: str) -> Column:
    """Whether a cell is in a unit: it is the cell's, or stands behind a number in its text.

    A unit of one letter is meant as it is written; others in any case. Percent signs and words are one.
    """
    if unit in ("%", "percent"):
        return (cell_unit == "%") | raw.rlike(r"(?i)\d\s*(?:%|percent\b)")
    flag = "" if len(unit) == 1 else "(?i)"
    text = raw.rlike(flag + r"\d\s*" + re.escape(unit) + r"(?![\p{L}\p{N}])")
    same = (cell_unit == unit) if len(unit) == 1 else (F.lower(cell_unit) == unit.lower())
    return F.coalesce(same, F.lit(False)) | text


def holds(left: Column, operator: str, right: str) -> Column:
    """A predicate on a cell's value: as decimals if both are, else as text in lower case."""
    low = F.lower(left)
    if operator == "contains":
        return low.contains(right.lower())
    a, b = left.try_cast(EXACT), F.lit(right).try_cast(EXACT)
    test = {"eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y}[operator]
    return F.when(a.isNotNull() & b.isNotNull(), test(a, b)).otherwise(test(low, F.lit(right.lower())))


def _data_rows(plan: TablePlan, cells: DataFrame) -> DataFrame:
    """Cells of the rows that pass all filters; the header is no data. One aggregate decides a row, without a join per filter."""
    data = cells.where("row_index > 0")
    if not plan.filters:
        return data
    passed = []
    for i, p in enumerate(plan.filters):
        value = F.coalesce("normalized_value", "raw_value")
        ok = (F.col("column_index") == p.column) & F.coalesce(holds(value, p.operator, p.value), F.lit(False))
        if p.unit:
            ok = ok & has_unit(F.col("unit"), F.col("raw_value"), p.unit)
        passed.append(F.max(ok).alias(f"_p{i}"))
    columns = sorted({p.column for p in plan.filters})
    rows = data.where(F.col("column_index").isin(*columns)).groupBy("table_id", "row_index").agg(*passed)
    for i in range(len(passed)):
        rows = rows.where(f"_p{i}")
    return data.join(rows.select("table_id", "row_index"), ["table_id", "row_index"], "left_semi")


def _numbers(plan: TablePlan, rows: DataFrame) -> DataFrame:
    out = rows.where((F.col("column_index") == plan.value_column) & F.col("value_type").isin(*NUMERIC) & F.col("normalized_value").isNotNull())
    if plan.unit:
        out = out.where(has_unit(F.col("unit"), F.col("raw_value"), plan.unit))
    return out.withColumn("_v", F.col("normalized_value").try_cast(EXACT)).where("_v is not null")


def _aggregated(how: str, keys: list[str], numbers: DataFrame) -> DataFrame:
    """keys, value, unit, cell_refs, n_cells, status. A null unit is a unit of its own; several make the answer void. Of the cells the first 10,000 are cited."""
    # the refs in the order of rows; of equal least or greatest values the first row's
    numbers = numbers.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("row_index")))
    pairs = F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= MOST_REFS, F.struct("row_index", "cell_ref")))), lambda x: x["cell_ref"])
    value = {"sum": F.sum("_v"), "mean": F.try_divide(F.sum("_v").cast("decimal(38,12)"), F.count("_v").cast("decimal(20,0)")), "min": F.min("_v"), "max": F.max("_v")}[how]
    first = {"min": F.min_by("cell_ref", F.struct("_v", "row_index")), "max": F.max_by("cell_ref", F.struct("_v", -F.col("row_index")))}.get(how)
    units = F.count_distinct(F.coalesce("unit", F.lit("∅")))
    of = numbers.groupBy(*keys).agg(value.alias("_value"), units.alias("_units"), F.max("unit").alias("_unit"), (F.array(first) if first is not None else pairs).alias("_refs"), pairs.alias("_all"), F.count("*").alias("n_cells"))
    mixed = F.col("_units") > 1
    return of.select(*keys, F.when(~mixed, canonical_decimal(F.col("_value"))).alias("value"), F.when(~mixed, F.col("_unit")).alias("unit"), F.when(~mixed, F.col("_refs")).alias("cell_refs"), F.when(~mixed, F.col("_all")).alias("verification_refs"), "n_cells", F.when(mixed, "mixed_incompatible_units").otherwise("ok").alias("status"))


def _row_results(rows: DataFrame, *more: str) -> DataFrame:
    of = rows.groupBy("table_id", "row_index", *more).agg(F.array_sort(F.collect_list(F.struct("column_index", "raw_value", "cell_ref"))).alias("_c"))
    return of.select("table_id", "row_index", *more, F.transform("_c", lambda x: x["raw_value"]).alias("row_values"), F.transform("_c", lambda x: x["cell_ref"]).alias("cell_refs"))


def execute(plan: TablePlan, cells: DataFrame) -> DataFrame:
    """The plan's answers, a row each, with table_id and a place within the table where there can be several.

    cells has table_id, row_index, column_index, cell_ref, raw_value, normalized_value, value_type and unit.
    """
    if plan.tables:
        cells = cells.where(F.col("table_id").isin(*plan.tables))
    place = Window.partitionBy("table_id")
    tables = cells.select("table_id").distinct()
    op = plan.operation
    if op == "lookup":
        found = cells
        if plan.operands:
            found = found.where(F.col("cell_ref").isin(*plan.operands))
        if plan.unit:
            found = found.where(has_unit(F.col("unit"), F.col("raw_value"), plan.unit))
        if plan.search:
            found = found.where(F.lower("raw_value").contains(plan.search.lower()))
        if not (plan.operands or plan.unit or plan.search):
            found = found.where("false")
        found = found.withColumn("place", F.row_number().over(place.orderBy("row_index", "column_index"))).where(F.col("place") <= plan.limit)
        return found.select("table_id", "place", "row_index", "column_index", F.coalesce("normalized_value", "raw_value").alias("value"), F.coalesce("unit", F.lit(plan.unit)).alias("unit"), "cell_ref")
    if op in ("compare", "difference", "percentage"):
        return _binary(plan, cells, tables)
    rows = _data_rows(plan, cells)
    if op == "filter":
        kept = rows.select("table_id", "row_index").distinct().withColumn("place", F.row_number().over(place.orderBy("row_index"))).where(F.col("place") <= plan.limit)
        return _row_results(rows.join(kept, ["table_id", "row_index"]), "place")
    if op == "count":
        lead = rows.groupBy("table_id", "row_index").agg(F.min_by("cell_ref", "column_index").alias("_ref"))
        lead = lead.withColumn("_k", F.row_number().over(place.orderBy("row_index")))
        n = lead.groupBy("table_id").agg(F.count("*").alias("_n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= MOST_REFS, F.struct("row_index", "_ref")))), lambda x: x["_ref"]).alias("verification_refs"))
        return tables.join(n, "table_id", "left").select("table_id", F.coalesce("_n", F.lit(0)).cast("string").alias("value"), F.coalesce("verification_refs", F.array().cast("array<string>")).alias("verification_refs"))
    if op == "group":
        keys = rows.where(F.col("column_index") == plan.group_column).select("table_id", "row_index", F.col("raw_value").alias("group"), F.col("cell_ref").alias("_ref"))
        how = plan.aggregate or "count"
        if how == "count":
            keys = keys.withColumn("_k", F.row_number().over(Window.partitionBy("table_id", "group").orderBy("row_index")))
            of = keys.groupBy("table_id", "group").agg(F.count("*").cast("string").alias("value"), F.lit(None).cast("string").alias("unit"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= MOST_REFS, F.struct("row_index", "_ref")))), lambda x: x["_ref"]).alias("cell_refs"), F.lit("ok").alias("status"))
        else:
            of = _aggregated(how, ["table_id", "group"], _numbers(plan, rows).join(keys, ["table_id", "row_index"])).drop("verification_refs", "n_cells")
        of = of.withColumn("place", F.row_number().over(place.orderBy(F.lower("group"), "group"))).where(F.col("place") <= plan.limit)
        return of.select("table_id", "place", "group", "value", "unit", "cell_refs", "status")
    numbers = _numbers(plan, rows)
    if op == "sort":
        by = [F.col("_v"), F.col("row_index")] if plan.direction == "asc" else [F.desc("_v"), F.desc("row_index")]
        kept = numbers.withColumn("place", F.row_number().over(place.orderBy(*by))).where(F.col("place") <= plan.limit).select("table_id", "row_index", "place")
        return _row_results(rows.join(kept, ["table_id", "row_index"]), "place")
    of = _aggregated(op, ["table_id"], numbers)
    return tables.join(of, "table_id", "left").withColumn("status", F.coalesce("status", F.lit("no_numeric_values")))


def _binary(plan: TablePlan, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Two cells of one table: an aggregate per table picks both, counts them and compares their units."""
    left, right = (F.col("cell_ref") == ref for ref in plan.operands)
    number = F.when(F.col("value_type").isin(*NUMERIC), F.col("normalized_value").try_cast(EXACT))
    of = cells.where(left | right).groupBy("table_id").agg(
        F.count_if(left).alias("_nl"),
        F.count_if(right).alias("_nr"),
        F.max(F.when(left, number)).alias("_l"),
        F.max(F.when(right, number)).alias("_r"),
        F.count_distinct(F.coalesce("unit", F.lit("∅"))).alias("_units"),
        F.max("unit").alias("_unit"),
    )
    of = tables.join(of, "table_id", "left")
    same = plan.operands[0] == plan.operands[1]
    status = (
        F.when(F.lit(same) | F.col("_nl").isNull() | (F.col("_nl") != 1) | (F.col("_nr") != 1), "missing_or_ambiguous_operand")
        .when(F.col("_l").isNull() | F.col("_r").isNull(), "non_numeric_operand")
        .when(F.col("_units") > 1, "mixed_incompatible_units")
        .otherwise(F.when((F.col("_r") == 0) & F.lit(plan.operation == "percentage"), "division_by_zero").otherwise("ok"))
    )
    l, r = F.col("_l"), F.col("_r")
    if plan.operation == "compare":
        value, unit = F.when(l == r, "equal").when(l > r, "greater").otherwise("less"), F.lit(None).cast("string")
    elif plan.operation == "difference":
        value, unit = canonical_decimal((l - r).cast(EXACT)), F.col("_unit")
    else:
        value, unit = canonical_decimal((F.try_divide((l - r).cast("decimal(30,10)"), r.cast("decimal(20,8)")) * 100).cast("decimal(38,10)")), F.lit("%")
    of = of.withColumn("status", status)
    return of.select("table_id", F.when(F.col("status") == "ok", value).alias("value"), F.when(F.col("status") == "ok", unit).alias("unit"), "status")


def unknown_columns(plan: TablePlan, columns: DataFrame) -> DataFrame:
    """table_id, column_index: columns that the plan asks for and a table of it lacks."""
    asked = {p.column for p in plan.filters} | {c for c in (plan.value_column, plan.group_column) if c is not None}
    if not asked:
        return columns.select("table_id", "column_index").where("false")
    if plan.tables:
        columns = columns.where(F.col("table_id").isin(*plan.tables))
    wanted = columns.select("table_id").distinct().select("table_id", F.explode(F.array(*[F.lit(c).cast("bigint") for c in sorted(asked)])).alias("column_index"))
    return wanted.join(columns.select("table_id", F.col("column_index").cast("bigint").alias("column_index")), ["table_id", "column_index"], "left_anti")


# Cues in a question and the operation they stand for; the first that matches wins.
CUES = (
    ("count", r"\b(?:how many|count|number of)\b"),
    ("mean", r"\b(?:average|mean)\b"),
    ("sum", r"\b(?:sum|total)\b"),
    ("max", r"\b(?:max(?:imum)?|highest|largest|greatest|most)\b"),
    ("min", r"\b(?:min(?:imum)?|lowest|smallest|least)\b"),
    ("sort", r"\b(?:sort|rank|order by)\b"),
    ("filter", r"\b(?:greater than|less than|more than|at least|at most|above|below|equal to)\b"),
)
FILTER_CUES = (("gte", r"\bat least\b"), ("lte", r"\bat most\b"), ("gt", r"\b(?:greater than|more than|above)\b"), ("lt", r"\b(?:less than|below)\b"), ("eq", r"\bequal to\b"))


def operation_cue(prompt: Column) -> Column:
    """The operation that a question's words ask for; lookup if none does."""
    out = F.lit("lookup")
    for name, pattern in reversed(CUES):
        out = F.when(F.lower(prompt).rlike(pattern), name).otherwise(out)
    return out


def filter_cue(prompt: Column) -> Column:
    """struct<operator, value>: the comparison and the first number behind it; null without both."""
    lower, operator, value = F.lower(prompt), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(FILTER_CUES):
        operator = F.when(lower.rlike(pattern), name).otherwise(operator)
        value = F.when(lower.rlike(pattern), F.regexp_extract(lower, pattern + r"\D*?([-+]?\d+(?:\.\d+)?)", 1)).otherwise(value)
    return F.when(operator.isNotNull() & (value != ""), F.struct(operator.alias("operator"), value.alias("value")))


def best_column(columns: DataFrame, terms: Column) -> DataFrame:
    """Of each table the column whose header shares most terms with terms; none where that is a tie or nothing."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("raw_header"), F.lit("([a-z0-9µμ]{2,})"), F.lit(1)))
    scored = columns.withColumn("_n", F.size(F.array_intersect(words, terms))).where("_n > 0")
    ranked = scored.withColumn("_r", F.rank().over(Window.partitionBy("table_id").orderBy(F.desc("_n")))).where("_r = 1")
    return ranked.groupBy("table_id").agg(F.count("*").alias("_c"), F.min("column_index").alias("column_index"), F.max("_n").alias("shared_terms")).where("_c = 1").drop("_c")
