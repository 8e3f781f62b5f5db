"""Questions in words to table plans, for any number of questions at once, and answers to cited sources.

A question meets documents and headers through terms: joins of exploded terms, counted. What is ambiguous is no plan
but a row with a reason, so nothing is guessed and no question stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.numbers import canonical_decimal
from tessella.operators.typed import EXACT, NUMERIC
from tessella.plans.table_plan import filter_cue

# What makes a question one about tables, quoted titles, words that say nothing, cues of operations in
# their order of precedence, the bounds of a plan.
TABLE_CUES = r"(?i)\b(?:table|row|rows|column|columns|cell|cells|value|values|average|mean|sum|total|count|minimum|maximum|highest|lowest|sort|group|difference|percent)\b"
TARGET = "[\"“]([^\"”]{4,240})[\"”]"
STOPWORDS = ("a", "an", "and", "as", "at", "by", "does", "for", "from", "in", "is", "of", "on", "or", "paper", "report", "source", "study", "target", "the", "to", "use", "what", "which", "with")
GENERIC = ("analysis", "augmented", "benchmark", "data", "evaluation", "generation", "language", "learning", "model", "models", "paper", "retrieval", "study")
OPERATION_CUES = (
    ("percentage", ("percent change", "percentage change", "percentage difference")),
    ("difference", ("difference between", "subtract")),
    ("mean", ("average", "mean")),
    ("sum", ("sum", "total of")),
    ("count", ("how many", "count")),
    ("min", ("minimum", "lowest", "smallest")),
    ("max", ("maximum", "highest", "largest", "heaviest", "most")),
    ("sort", ("sort", "order by")),
    ("group", ("group by", "grouped by")),
    ("compare", ("compare", "versus", " vs ")),
    ("filter", ("where ", "greater than", "less than", "equal to")),
)
NEED_OPERANDS = ("compare", "difference", "percentage", "group")
MOST_TABLES, MOST_CANDIDATES, MOST_CELLS, MOST_ROWS = 16, 64, 5_000, 24
NUMBER = r"[-+]?(?:\d+(?:,\d{3})*(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?"


def terms(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9µμ]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(*STOPWORDS)))


def operation_of(prompt: Column) -> Column:
    """The first operation of which a cue stands anywhere in a question; lookup if none does."""
    out, low = F.lit("lookup"), F.lower(prompt)
    for name, cues in reversed(OPERATION_CUES):
        found = low.contains(cues[0])
        for cue in cues[1:]:
            found = found | low.contains(cue)
        out = F.when(found, name).otherwise(out)
    return out


def unit_of(prompt: Column) -> Column:
    """The unit that a question wants its answer expressed in; % where it speaks of percent."""
    said = F.regexp_extract(prompt, r"\bexpressed\s+in\s+([A-Za-zµμ%]+)", 1)
    return F.when(F.lower(said) == "percent", "%").when(said != "", said).when(prompt.rlike(r"(?i)\bpercent(?:age)?\b"), "%")


def in_unit(raw: Column, stored: Column, unit: Column) -> Column:
    """Whether a cell is in a unit: stored with it, or with a number before it in its text; units of one letter as written."""
    value = NUMBER + r"(?:\s*(?:±|\+/-)\s*" + NUMBER + r")?\s*"
    pattern = F.concat(F.when((F.char_length(unit) > 1), F.lit("(?i)")).otherwise(F.lit("")), F.lit(value), F.lit(r"\Q"), unit, F.lit(r"\E"), F.when(unit == "%", F.lit("")).otherwise(F.lit("(?![A-Za-zµμ])")))
    same = (stored == unit) | ((F.char_length(unit) > 1) & (F.lower(stored) == F.lower(unit)))
    return F.coalesce(same, F.lit(False)) | F.coalesce(F.regexp_like(raw, pattern), F.lit(False))


def plan_questions(questions: DataFrame, documents: DataFrame, tables: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """query_id, status, reason, operation, table_ids, value_column, unit, filter, direction: a plan for each question, or why there is none.

    questions has query_id, text; documents doc_id, display_name, path; tables id, doc_id, page_number, table_index;
    columns table_id, column_index, normalized_header; cells table_id, raw_value, unit. A quoted title names a document:
    the one that shares most terms with it (a generic term counts a tenth), if it is one. Of its tables the one whose
    best header shares most terms with the question is taken, matches of the unit breaking ties; a tie is no answer.
    """
    q = questions.select("query_id", "text").dropDuplicates(["query_id"]).where("query_id is not null")
    found = F.regexp_extract_all("text", F.lit(TARGET), F.lit(1))
    q = q.select("query_id", "text", F.when(F.size(found) > 0, F.element_at(found, -1)).alias("target"), operation_of(F.col("text")).alias("operation"), unit_of(F.col("text")).alias("unit"), F.coalesce(F.col("text").rlike(TABLE_CUES), F.lit(False)).alias("asks"))
    asked = q.where("asks")
    # documents that have tables, by the terms of their names
    docs = documents.select("doc_id", "display_name", "path").dropDuplicates(["doc_id"]).join(tables.select("doc_id").distinct(), "doc_id", "left_semi")
    identity = docs.select("doc_id", F.explode(terms(F.concat_ws(" ", "display_name", "path"))).alias("term"))
    wanted = asked.where("target is not null").select("query_id", F.explode(terms(F.col("target"))).alias("term"))
    points = wanted.join(identity, "term").groupBy("query_id", "doc_id").agg(F.sum(F.when(F.col("term").isin(*GENERIC), 1).otherwise(10)).alias("n"))
    first = points.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("n")))).where("r = 1").groupBy("query_id").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1")
    only = docs.agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("only"))
    resolved = asked.join(first.select("query_id", "doc_id"), "query_id", "left").crossJoin(F.broadcast(only))  # one row
    resolved = resolved.withColumn("doc_id", F.when(F.col("target").isNotNull(), F.col("doc_id")).when(F.col("n_docs") == 1, F.col("only")))
    # candidate tables and what of them the question's terms and unit meet
    pairs = resolved.where("doc_id is not null").join(tables.select(F.col("id").alias("table_id"), "doc_id", "page_number", "table_index").dropDuplicates(["table_id"]), "doc_id")
    pairs = pairs.withColumn("n_tables", F.count("*").over(Window.partitionBy("query_id")))
    words = F.array_except(terms(F.col("text")), F.coalesce(terms(F.col("target")), F.array().cast("array<string>")))
    headers = columns.select("table_id", "column_index", terms(F.col("normalized_header")).alias("h")).dropDuplicates(["table_id", "column_index"])
    met = pairs.select("query_id", "table_id", words.alias("w")).join(headers, "table_id").select("query_id", "table_id", "column_index", F.size(F.array_intersect("h", "w")).alias("n"))
    best = met.withColumn("top", F.max("n").over(Window.partitionBy("query_id", "table_id"))).where("n = top and n > 0").groupBy("query_id", "table_id").agg(F.count("*").alias("c"), F.min("column_index").alias("column"), F.max("n").alias("n"))
    scanned = cells.select("table_id", "raw_value", F.col("unit").alias("_u")).join(pairs.where("unit is not null").select("table_id", "query_id", "unit"), "table_id")
    units = scanned.groupBy("query_id", "table_id").agg(F.count("*").alias("scanned"), F.count_if(in_unit(F.col("raw_value"), F.col("_u"), F.col("unit"))).alias("in_unit"))
    scored = pairs.join(best, ["query_id", "table_id"], "left").join(units, ["query_id", "table_id"], "left")
    header = F.when(F.col("c") > 1, -1).otherwise(F.coalesce("n", F.lit(0)))
    scored = scored.select("query_id", "table_id", "page_number", "table_index", "n_tables", F.when(F.col("c") == 1, F.col("column")).alias("column"), F.coalesce("in_unit", F.lit(0)).alias("in_unit"), (F.coalesce("scanned", F.lit(0)) > MOST_CELLS).alias("too_long"), (header * 10 + F.least(F.coalesce("in_unit", F.lit(0)), F.lit(9))).alias("score"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.coalesce("page_number", F.lit(0)).alias("p"), "table_index", "table_id", "column", "in_unit")))
    of = scored.groupBy("query_id").agg(order.alias("all"), F.max("n_tables").alias("n_tables"), F.max("too_long").alias("too_long"))
    matching = F.filter("all", lambda x: x["s"] < 0)
    hits = F.transform(F.filter("matching", lambda x: x["in_unit"] > 0), lambda x: x["table_id"])
    out = resolved.join(of, "query_id", "left").withColumn("matching", matching).withColumn("hits", hits)
    top = F.get("matching", F.lit(0))
    comparison = filter_cue(F.col("text"))
    reason = (
        F.when(F.col("n_docs") == 0, "no_typed_tables")
        .when(F.col("doc_id").isNull(), F.when(F.col("n_docs") > 1, "cross_document_ambiguity").otherwise("document_not_found"))
        .when(F.col("n_tables").isNull(), "document_has_no_tables")
        .when(F.col("n_tables") > MOST_CANDIDATES, "candidate_table_limit")
        .when(F.col("too_long"), "planning_cell_limit")
        .when((F.col("operation") == "lookup") & F.col("unit").isNotNull(), F.when(F.size("hits") == 0, "unit_not_found").when(F.size("hits") > MOST_TABLES, "table_limit"))
        .when(F.col("operation").isin(*NEED_OPERANDS), "operation_requires_explicit_operands")
        .when((F.col("operation") == "count") & (F.size("matching") == 0), F.when(F.col("n_tables") > 1, "ambiguous_table"))
        .when(F.size("matching") == 0, "column_not_found")
        .when(top["s"] == F.get("matching", F.lit(1))["s"], "ambiguous_table")
        .when(~F.col("operation").isin("lookup", "count") & top["column"].isNull(), "column_not_found")
        .when((F.col("operation") == "filter") & comparison.isNull(), "ambiguous_filter")
    )
    by_unit = (F.col("operation") == "lookup") & F.col("unit").isNotNull()
    ids = F.when(by_unit, F.col("hits")).when(F.size("matching") > 0, F.array(top["table_id"])).otherwise(F.transform("all", lambda x: x["table_id"]))
    planned = out.withColumn("reason", reason).select("query_id", "reason", "operation", ids.alias("ids"), F.when(~by_unit, top["column"]).alias("column"), "unit", F.when(F.col("operation") == "filter", comparison).alias("filter"))
    rest = q.where("not asks").select("query_id", F.lit("not_a_table_question").alias("reason"), F.lit(None).cast("string").alias("operation"))
    both = planned.unionByName(rest, allowMissingColumns=True)
    kept = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    return both.select("query_id", F.when(F.col("reason").isNull(), "planned").otherwise("fallback").alias("status"), "reason", kept("operation").alias("operation"), kept("ids").alias("table_ids"), kept("column").alias("value_column"), kept("unit").alias("unit"), kept("filter").alias("filter"), F.when(F.col("reason").isNull(), F.when(F.col("operation") == "max", "desc").otherwise("asc")).alias("direction"))


def answer_plans(plans: DataFrame, cells: DataFrame) -> DataFrame:
    """query_id, table_id, operation, value, unit, cell_refs, status: what planned questions that ask for one number, or for cells in a unit, come to.

    cells has table_id, row_index, column_index, cell_ref, raw_value, normalized_value, value_type, unit. One shuffle by
    table for all plans; of lookups the first 24 cells are values of their own. cell_refs are the first 24 cells that a
    number comes from, n_cells how many it comes from.
    """
    one = plans.where("status = 'planned'").select("query_id", "operation", F.col("value_column").alias("_c"), F.col("unit").alias("_unit"), F.explode("table_ids").alias("table_id"))
    rows = cells.where("row_index > 0").join(one, "table_id").withColumn("_v", F.when(F.col("value_type").isin(*NUMERIC), F.col("normalized_value").try_cast(EXACT)))
    own = F.col("_unit").isNull() | in_unit(F.col("raw_value"), F.col("unit"), F.col("_unit"))
    numbers = rows.where(F.col("operation").isin("min", "max", "sum", "mean") & (F.col("column_index") == F.col("_c")) & F.col("_v").isNotNull() & own)
    place = Window.partitionBy("query_id", "table_id").orderBy("row_index")
    numbers = numbers.withColumn("_k", F.row_number().over(place))
    mean = F.try_divide(F.sum("_v").cast("decimal(38,12)"), F.count("_v").cast("decimal(20,0)"))
    op = F.first("operation")
    of = numbers.groupBy("query_id", "table_id").agg(
        op.alias("operation"),
        canonical_decimal(F.when(op == "sum", F.sum("_v")).when(op == "min", F.min("_v")).when(op == "max", F.max("_v")).otherwise(mean)).alias("_value"),
        F.count_distinct(F.coalesce("unit", F.lit("∅"))).alias("_units"),
        F.max("unit").alias("_unit"),
        F.array_sort(F.collect_list(F.when(F.col("_k") <= MOST_ROWS, F.struct("_k", "cell_ref")))).alias("_refs"),
        F.count("*").alias("n_cells"),
    )
    mixed = F.col("_units") > 1
    refs = F.transform("_refs", lambda r: r["cell_ref"])
    values = of.select("query_id", "table_id", "operation", F.when(~mixed, F.col("_value")).alias("value"), F.when(~mixed, F.col("_unit")).alias("unit"), F.when(~mixed, refs).alias("cell_refs"), "n_cells", F.when(mixed, "mixed_incompatible_units").otherwise("ok").alias("status"))
    empty = one.where(F.col("operation").isin("min", "max", "sum", "mean")).join(values.select("query_id", "table_id"), ["query_id", "table_id"], "left_anti")
    values = values.unionByName(empty.select("query_id", "table_id", "operation", F.lit("no_numeric_values").alias("status"), F.lit(0).cast("bigint").alias("n_cells")), allowMissingColumns=True)
    counts = one.where("operation = 'count'").join(cells.where("row_index > 0").groupBy("table_id").agg(F.count_distinct("row_index").alias("n_cells")), "table_id", "left")
    counts = counts.select("query_id", "table_id", "operation", F.coalesce("n_cells", F.lit(0)).cast("string").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("array<string>").alias("cell_refs"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.lit("ok").alias("status"))
    looked = rows.where((F.col("operation") == "lookup") & F.col("_unit").isNotNull() & own)
    looked = looked.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("table_id", "row_index", "column_index"))).where(F.col("_k") <= MOST_ROWS)
    looked = looked.select("query_id", "table_id", "operation", F.coalesce("normalized_value", "raw_value").alias("value"), F.coalesce("unit", "_unit").alias("unit"), F.array("cell_ref").alias("cell_refs"), F.lit(1).cast("bigint").alias("n_cells"), F.lit("ok").alias("status"))
    return values.unionByName(counts).unionByName(looked)


def cited_results(answers: DataFrame, tables: DataFrame, documents: DataFrame, cells: DataFrame) -> DataFrame:
    """query_id, source_id, doc_id, doc_name, chunk_id, kind, table_id, table_title, page_number, cell_refs, header_refs, values: answers as sources that can be cited, a row per question and table.

    answers is of answer_plans. A result's name is a digest of its table, operation and values, so that one result has
    one name. header_refs are the header cells above the cells it comes from.
    """
    good = answers.where("status = 'ok'")
    of = good.groupBy("query_id", "table_id", "operation").agg(F.array_sort(F.collect_list(F.struct("value", "unit"))).alias("values"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("cell_refs", F.array().cast("array<string>")))))).alias("cell_refs"))
    cited = of.select("query_id", "table_id", F.explode("cell_refs").alias("cell_ref")).join(cells.select("table_id", "cell_ref", "column_index").distinct(), ["table_id", "cell_ref"])
    heads = cited.select("query_id", "table_id", "column_index").distinct().join(cells.where("row_index = 0").select("table_id", "column_index", F.col("cell_ref").alias("h")), ["table_id", "column_index"]).groupBy("query_id", "table_id").agg(F.array_sort(F.collect_set("h")).alias("header_refs"))
    names = tables.select(F.col("id").alias("table_id"), "doc_id", F.col("caption").alias("table_title"), "page_number").dropDuplicates(["table_id"]).join(documents.select("doc_id", F.coalesce("display_name", F.element_at(F.split("path", r"[/\\]"), -1)).alias("doc_name")).dropDuplicates(["doc_id"]), "doc_id", "left")
    out = of.join(heads, ["query_id", "table_id"], "left").join(names, "table_id", "left")
    said = F.array_join(F.transform("values", lambda v: F.concat_ws(" ", v["value"], v["unit"])), "\x1e")
    digest = F.substring(F.sha2(F.concat_ws("\x1f", "table_id", "operation", said), 256), 1, 16)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("table_id"))
    return out.select("query_id", F.concat(F.lit("S"), place.cast("string")).alias("source_id"), "doc_id", "doc_name", F.concat(F.lit("table-result-"), digest).alias("chunk_id"), F.when(F.size("cell_refs") > 0, "cell").otherwise("table").alias("kind"), "table_id", "table_title", "page_number", "cell_refs", F.coalesce("header_refs", F.array().cast("array<string>")).alias("header_refs"), "values")
