from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import typed
from tessella.plans.table_plan import Predicate, TablePlan, UnsafePlan, best_column, execute, filter_cue, operation_cue, unknown_columns

HARBOURS = [["Harbour", "Coast", "Depth", "Berths in use"], ["Lomvik", "west", "7.5 m", "40%"], ["Sandøy", "west", "12 m", "85%"], ["Tarva", "north", "4 m", "10%"], ["Vesla", "north", "6 m", ""], ["Yttre", "west", "n/a", "62.5%"]]
TABLE = "harbours"


@pytest.fixture
def harbours(spark):
    tables = spark.createDataFrame([(TABLE, "csv", None, None, HARBOURS)], "table_id string, source_type string, sheet_name string, page_number bigint, rows array<array<string>>")
    return typed.build_cells(tables)


CELLS = {
    "0": ("0", "integer", None),
    "+7": ("7", "integer", None),
    "007.50": ("7.5", "decimal", None),
    "3E+4": ("30000", "decimal", None),
    "2.5e-3": ("0.0025", "decimal", None),
    "9,876,543": ("9876543", "integer", None),
    "98,76": ("98,76", "text", None),
    "0.30 %": ("0.3", "percentage", "%"),
    "18.0 km/h": ("18", "decimal", "km/h"),
    "False": ("false", "boolean", None),
    "9e999": ("9e999", "text", None),
    "seven": ("seven", "text", None),
    "   ": (None, "missing", None),
}


def test_cell_typing(spark):
    rows = spark.createDataFrame([(k,) for k in [*CELLS, None]], "r string").select("r", typed.typed_cell(F.col("r")).alias("t")).collect()
    got = {r.r: (r.t.normalized, r.t.value_type, r.t.unit) for r in rows}
    assert got == CELLS | {None: (None, "missing", None)}


def test_building_ragged_rows_and_refs(spark):
    tables = spark.createDataFrame([("t", "xlsx", "Depths", None, [["a", "b", "c"], ["1", "2"]]), ("u", "pdf", None, 12, [["x"], ["y"]]), ("v", "csv", None, None, [])], "table_id string, source_type string, sheet_name string, page_number bigint, rows array<array<string>>")
    got = {r.cell_ref: r.parse_warnings for r in typed.build_cells(tables).collect()}
    assert got == {"Depths!A1": None, "Depths!B1": None, "Depths!C1": None, "Depths!A2": None, "Depths!B2": None, "Depths!C2": "ragged_row", "p12:r1c1": None, "p12:r2c1": None}
    letters = spark.range(18279).select(typed.column_letters(F.col("id")).alias("x")).collect()
    assert [letters[i].x for i in (1, 24, 27, 77, 729, 18277)] == ["B", "Y", "AB", "BZ", "ABB", "ZZZ"]
    formats = spark.createDataFrame([("0%",), ("#,##0.00%",), ('0" %"',), ("General",), (None,)], "f string").select(typed.percent_format(F.col("f")).alias("x")).collect()
    assert [r.x for r in formats] == [True, True, False, False, False]


def test_column_inference(harbours):
    got = {r.raw_header: (r.normalized_header, r.inferred_type, r.inferred_unit) for r in typed.infer_columns(harbours).collect()}
    assert got == {"Harbour": ("harbour", "text", None), "Coast": ("coast", "text", None), "Depth": ("depth", "mixed", "m"), "Berths in use": ("berths_in_use", "percentage", "%")}


def rows(plan, cells, *columns):
    return [tuple(r[c] for c in columns) for r in execute(plan, cells).collect()]


@pytest.mark.parametrize(
    ("plan", "columns", "want"),
    [
        (TablePlan("count", filters=(Predicate(1, "eq", "WEST"),)), ("value", "verification_refs"), [("3", ["csv:r2c1", "csv:r3c1", "csv:r6c1"])]),
        (TablePlan("min", value_column=2), ("value", "unit", "cell_refs"), [("4", "m", ["csv:r4c3"])]),
        (TablePlan("max", value_column=2), ("value", "cell_refs", "verification_refs"), [("12", ["csv:r3c3"], ["csv:r2c3", "csv:r3c3", "csv:r4c3", "csv:r5c3"])]),
        (TablePlan("sum", value_column=2), ("value", "unit", "status"), [("29.5", "m", "ok")]),
        (TablePlan("mean", value_column=2, filters=(Predicate(1, "eq", "north"),)), ("value", "unit"), [("5", "m")]),
        (TablePlan("group", group_column=1, value_column=2, aggregate="mean"), ("group", "value"), [("north", "5"), ("west", "9.75")]),
        (TablePlan("group", group_column=1, value_column=2, aggregate="max"), ("group", "value"), [("north", "6"), ("west", "12")]),
        (TablePlan("compare", operands=("csv:r3c3", "csv:r2c3")), ("value",), [("greater",)]),
        (TablePlan("difference", operands=("csv:r2c3", "csv:r3c3")), ("value", "unit"), [("-4.5", "m")]),
        (TablePlan("percentage", operands=("csv:r5c3", "csv:r4c3")), ("value", "unit"), [("50", "%")]),
        (TablePlan("lookup", search="ndø"), ("cell_ref",), [("csv:r3c1",)]),
        (TablePlan("lookup", unit="%"), ("cell_ref",), [(f"csv:r{n}c4",) for n in (2, 3, 4, 6)]),
        (TablePlan("lookup"), ("value",), []),
        (TablePlan("lookup", search="' or 1=1"), ("value",), []),
        (TablePlan("filter", filters=(Predicate(2, "lte", "6", "ft"),)), ("row_values",), []),
    ],
)
def test_plans(harbours, plan, columns, want):
    assert sorted(rows(plan, harbours, *columns)) == want


def test_filters_and_sorts_give_whole_rows(harbours):
    deep = TablePlan("filter", filters=(Predicate(2, "gte", "6.0"), Predicate(0, "contains", "S")))
    assert [r[0][0] for r in sorted(rows(deep, harbours, "row_values"))] == ["Sandøy", "Vesla"]
    shallow = TablePlan("sort", value_column=2, direction="asc", limit=3)
    assert [v[0] for _, v in sorted(rows(shallow, harbours, "place", "row_values"))] == ["Tarva", "Vesla", "Lomvik"]


def test_failures_are_data(spark, harbours):
    feet = harbours.withColumn("unit", F.when(F.col("cell_ref") == "csv:r5c3", "ft").otherwise(F.col("unit")))
    assert rows(TablePlan("max", value_column=2), feet, "value", "status") == [(None, "mixed_incompatible_units")]
    assert rows(TablePlan("difference", operands=("csv:r4c3", "csv:r5c3")), feet, "status") == [("mixed_incompatible_units",)]
    assert rows(TablePlan("mean", value_column=1), harbours, "status") == [("no_numeric_values",)]
    dry = harbours.withColumn("normalized_value", F.when(F.col("cell_ref") == "csv:r4c3", "0.0").otherwise(F.col("normalized_value")))
    assert rows(TablePlan("percentage", operands=("csv:r2c3", "csv:r4c3")), dry, "status") == [("division_by_zero",)]
    assert rows(TablePlan("difference", operands=("csv:r9c1", "csv:r2c3")), harbours, "status") == [("missing_or_ambiguous_operand",)]
    assert rows(TablePlan("compare", operands=("csv:r2c2", "csv:r2c3")), harbours, "status") == [("non_numeric_operand",)]
    assert execute(TablePlan("sum", value_column=2), harbours.limit(0)).count() == 0


@pytest.mark.parametrize(
    "payload",
    [{}, {"operation": "delete"}, {"operation": "mean"}, {"operation": "count", "sql": "select 1"}, {"operation": "count", "tables": ["no/id"]}, {"operation": "sort", "value_column": 1, "limit": 1000}, {"operation": "group"}, {"operation": "difference", "operands": ["r1c1"]}, {"operation": "filter", "filters": [{"column": 0, "operator": "regexp", "value": "."}]}],
)
def test_unsafe_plans(payload):
    with pytest.raises(UnsafePlan):
        TablePlan.parse(payload)


def test_planning_from_words(spark, harbours):
    df = spark.createDataFrame([("How many harbours have a depth of at least 6.5?",), ("the largest depth",), ("depth at Tarva",)], "p string")
    assert [r.x for r in df.select(operation_cue(F.col("p")).alias("x")).collect()] == ["count", "max", "lookup"]
    assert df.select(filter_cue(F.col("p")).alias("x")).first().x.asDict() == {"operator": "gte", "value": "6.5"}
    cols = typed.infer_columns(harbours)
    assert best_column(cols, F.array(F.lit("depth"))).first().column_index == 2
    assert unknown_columns(TablePlan("mean", value_column=7), cols).count() == 1 and unknown_columns(TablePlan("mean", value_column=3), cols).count() == 0
