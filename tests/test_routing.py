from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import typed
from tessella.plans.routing import answer_plans, cited_results, in_unit, plan_questions

GRAIN = [["Silo", "Dry weight", "Moisture"], ["north", "40 t", "12%"], ["south", "25 t", "15.5%"], ["east", "35 t", ""]]
RIVER = [["Station", "Flow", "Depth"], ["a", "3 m", "2 m"], ["b", "5 ft", "4 m"]]


@pytest.fixture
def library(spark, frame):
    cells = typed.build_cells(spark.createDataFrame([("g", "csv", None, None, GRAIN), ("r", "csv", None, 2, RIVER)], "table_id string, source_type string, sheet_name string, page_number bigint, rows array<array<string>>"))
    tables = frame([("g", 1, None, 0, "Silos"), ("r", 2, 2, 0, None)], "id string, doc_id bigint, page_number bigint, table_index bigint, caption string", "score")
    documents = frame([(1, "Grain harvest 2020", "/lib/grain.csv"), (2, None, "/lib/river_data.pdf"), (3, "Grain notes", "/lib/notes.txt")], "doc_id bigint, display_name string, path string")
    return documents, tables, typed.infer_columns(cells), cells


ASKED = {
    "mean": "What is the average dry weight in “Grain harvest”?",
    "count": 'How many rows has "grain harvest"?',
    "unit": 'Which values of "grain harvest" are there, expressed in percent?',
    "mixed": 'Total of the flow column in "river_data file"',
    "none": "Who wrote it?",
    "nowhere": 'The highest value in "unknown book"',
    "column": 'The highest value in "grain harvest"',
    "operands": 'The difference between weight values in "grain harvest"',
    "filter": 'Rows of "grain harvest" with dry weight greater than 30',
    "open": "The lowest depth value",
}


def test_plans_answers_and_citations(library, frame):
    documents, tables, columns, cells = library
    questions = frame([(k, v) for k, v in ASKED.items()] + [("null", None)], "query_id string, text string", "n")
    plans = plan_questions(questions, documents, tables, columns, cells)
    got = {r.query_id: r for r in plans.collect()}
    assert {k: r.reason for k, r in got.items() if r.reason} == {"none": "not_a_table_question", "null": "not_a_table_question", "nowhere": "cross_document_ambiguity", "column": "column_not_found", "operands": "operation_requires_explicit_operands", "open": "cross_document_ambiguity"}
    assert (got["mean"].operation, got["mean"].table_ids, got["mean"].value_column) == ("mean", ["g"], 1)
    assert (got["filter"].operation, got["filter"].filter.operator, got["filter"].filter.value) == ("filter", "gt", "30")
    answers = answer_plans(plans, cells)
    values = {(r.query_id, r.value, r.unit, r.status) for r in answers.collect()}
    assert values == {("mean", "33.333333333333", "t", "ok"), ("count", "3", None, "ok"), ("unit", "12", "%", "ok"), ("unit", "15.5", "%", "ok"), ("mixed", None, None, "mixed_incompatible_units")}
    cited = {r.query_id: r for r in cited_results(answers, tables, documents, cells).collect()}
    assert set(cited) == {"mean", "count", "unit"} and cited["mean"].cell_refs == ["csv:r2c2", "csv:r3c2", "csv:r4c2"] and cited["mean"].header_refs == ["csv:r1c2"]
    assert (cited["mean"].kind, cited["count"].kind, cited["mean"].doc_name, cited["mean"].source_id) == ("cell", "table", "Grain harvest 2020", "S1")
    assert len({r.chunk_id for r in cited.values()}) == 3 and all(len(r.chunk_id) == 29 for r in cited.values())


def test_empty_tables(library, frame):
    documents, tables, columns, cells = library
    questions = frame([("mean", ASKED["mean"])], "query_id string, text string")
    assert plan_questions(questions.limit(0), documents, tables, columns, cells).count() == 0
    none = plan_questions(questions, documents.limit(0), tables.limit(0), columns.limit(0), cells.limit(0))
    assert [r.reason for r in none.collect()] == ["no_typed_tables"] and answer_plans(none, cells).count() == 0


def test_units_in_cells(spark):
    cases = [("12 kg", None, "kg", True), ("12 KG", None, "kg", True), ("12 kgs", None, "kg", False), ("5 M", None, "m", False), ("1.5e3 ± 2 m", None, "m", True), ("m 5", None, "m", False), ("7", "Kg", "kg", True), ("3 %", None, "%", True), (None, None, "m", False), ("2 m.s", None, "m.s", True), ("2 mxs", None, "m.s", False)]
    rows = spark.createDataFrame(cases, "r string, s string, u string, w boolean").select("w", "r", in_unit(F.col("r"), F.col("s"), F.col("u")).alias("g")).collect()
    assert [(r.r, r.g) for r in rows] == [(r.r, r.w) for r in rows]
