"""Queries of layout, sources, sinks, the store and stateful streams, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import layout, typed
from tessella.queries import CELLS, SQL, query, sql
from tessella.session import shared_dir
from tessella.sources import files
from tessella.store import Store, violations
from tessella.streaming import events
from tessella.tables import table

# --- layout, on blocks as lines --------------------------------------------------------------------------------------

BLOCKS = "(select distinct on (block_id) * from document_blocks order by block_id)"
#: blocks as lines of pages: those of which the place, the size and the text are known
PLACED = f"(select block_id, doc_id, page_number as page, block_index as line_no, text, bounding_box[1] as x0, bounding_box[2] as top, bounding_box[3] as x1, bounding_box[4] as bottom, font_size as size, block_type from {BLOCKS} where bounding_box is not null and font_size is not null and page_number is not null and text is not null)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_blocks", "block_id", "doc_id", "page_number", "block_index", "text", "bounding_box", "font_size", "block_type").dropDuplicates(["block_id"])
    rows = rows.where("bounding_box is not null and font_size is not null and page_number is not null and text is not null")
    box = [F.col("bounding_box")[i].alias(n) for i, n in enumerate(("x0", "top", "x1", "bottom"))]
    return rows.select("block_id", "doc_id", F.col("page_number").alias("page"), F.col("block_index").alias("line_no"), "text", *box, F.col("font_size").alias("size"), "block_type")


BODY = f"bo as (select doc_id, s as body_size from (select doc_id, round(size, 1) as s, row_number() over (partition by doc_id order by sum(length(text)) desc, round(size, 1)) as k from {PLACED} group by doc_id, round(size, 1)) where k = 1)"


@query
def line_types(spark: SparkSession, d: str) -> DataFrame:
    """What each block is by its size and form, and how deep a heading it would be."""
    lines = _lines(spark, d)
    rows = lines.join(layout.body_size(lines), "doc_id")
    kind = layout.line_type(F.col("text"), F.col("size"), F.col("body_size"), F.lit(False), F.col("page"), F.col("line_no"))
    return rows.select("block_id", kind.alias("kind"), layout.heading_level(F.col("size"), F.col("body_size"), F.col("text")).alias("level"))


sql(
    "line_types",
    rf"""
with {BODY}, l as (select p.*, size / body_size as large, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) as words, regexp_extract(text, '^(\d+(?:\.\d+)*)\.?\s', 1) as number from {PLACED} p join bo using (doc_id))
select block_id, case when regexp_matches(text, '(?i)^(?:figure|fig\.|table|chart)\s*\d+') then 'caption' when regexp_matches(text, '^\s*(?:[-•*]|\d{{1,2}}[.)])\s+\S') then 'list'
  when large < 0.85 and regexp_matches(text, '^\s*(?:\d{{1,2}}|[*†‡])\s+\S') then 'footnote' when page = 1 and line_no = 0 and large >= 1.35 and words <= 20 then 'title'
  when words <= 14 and not regexp_matches(text, '[.,;:]$') and large >= 1.15 then 'heading' else 'paragraph' end as kind,
  case when number <> '' then least(len(string_split(number, '.')), 4) when large >= 1.6 then 1 when large >= 1.3 then 2 else 3 end::int as level from l
""",
)


@query
def reading_orders(spark: SparkSession, d: str) -> DataFrame:
    """The order in which each page's blocks are read, on pages as wide as their widest block reaches."""
    lines = _lines(spark, d)
    widths = lines.groupBy("doc_id", "page").agg(F.max("x1").alias("width"))
    return layout.reading_order(lines.dropDuplicates(["doc_id", "page", "top", "x0"]), widths).groupBy("doc_id", "page").agg(F.max("reading_no").alias("lines"), F.count_distinct("reading_no").alias("places"))


sql("reading_orders", f"select doc_id, page, count(*)::int as lines, count(*) as places from (select distinct doc_id, page, top, x0 from {PLACED}) group by all")


@query
def marginal_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that recur at the edges of a file's pages."""
    lines = _lines(spark, d)
    heights = lines.groupBy("doc_id", "page").agg(F.max("bottom").alias("height"))
    return layout.marginal_lines(lines, heights).select("block_id", "repeated")


sql(
    "marginal_blocks",
    rf"""
with p as (select * from {PLACED}), h as (select doc_id, page, max(bottom) as height from p group by all), n as (select doc_id, count(distinct page) as pages from h group by all),
e as (select p.*, lower(trim(regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '\s+', ' ', 'g'))) as k, bottom <= 0.12::double * height or top >= 0.9::double * height as edge from p join h using (doc_id, page)),
o as (select doc_id, k from e join n using (doc_id) where edge group by doc_id, k, pages having count(distinct page) >= greatest(2, (pages + 1) // 2))
select block_id, edge and exists (select 1 from o where o.doc_id = e.doc_id and o.k = e.k) as repeated from e
""",
)


@query
def outside_tables(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose centre lies in no other table's box on their page."""
    lines = _lines(spark, d)
    return layout.outside_boxes(lines.where("block_type <> 'table'"), lines.where("block_type = 'table'")).select("block_id")


sql("outside_tables", f"with p as (select * from {PLACED}) select block_id from p i where block_type <> 'table' and not exists (select 1 from p b where b.block_type = 'table' and b.doc_id = i.doc_id and b.page = i.page and (i.x0 + i.x1) / 2 between b.x0 and b.x1 and (i.top + i.bottom) / 2 between b.top and b.bottom)")


@query
def nearest_captions(spark: SparkSession, d: str) -> DataFrame:
    """Of every block the caption nearest to it on its page."""
    lines = _lines(spark, d)
    return layout.captions_of(lines.where("block_type <> 'caption'").withColumnRenamed("block_id", "asset_id"), lines.where("block_type = 'caption'"))


sql("nearest_captions", f"with p as (select * from {PLACED}), n as (select a.block_id as asset_id, c.text as caption, greatest(c.top - a.bottom, a.top - c.bottom, 0.0::double) as far from p a join p c using (doc_id, page) where a.block_type <> 'caption' and c.block_type = 'caption') select asset_id, caption from (select *, row_number() over (partition by asset_id order by far, caption) as k from n where far <= 72) where k = 1")


@query
def element_ids(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return lines.select("block_id", layout.element_id(F.col("doc_id"), F.col("page"), F.col("block_type"), F.col("text")).alias("element_id"))


sql("element_ids", f"select block_id, 'el-' || substr(sha256(doc_id || chr(31) || page || chr(31) || block_type || chr(31) || text), 1, 20) as element_id from {PLACED}")


@query
def cell_runs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of typed tables as lines of cells: runs of lines with equally many cells are tables."""
    rows = table(spark, d, "table_cells", "id", "table_id", "row_index", "column_index", "raw_value").dropDuplicates(["id"]).where("raw_value is not null")
    lines = rows.groupBy("table_id", "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "raw_value"))), lambda x: x["raw_value"]).alias("cells"))
    top = F.col("row_index") * 10.0
    lines = lines.select(F.col("table_id").alias("doc_id"), F.lit(1).alias("page"), F.col("row_index").alias("line_no"), "cells", F.lit(0.0).alias("x0"), top.alias("top"), (top + 8).alias("bottom"))
    return layout.borderless_tables(lines).select(F.col("doc_id").alias("table_id"), "table_no", "first_line", "last_line", F.size("rows").alias("n_rows"))


sql(
    "cell_runs",
    f"""
with l as (select table_id, row_index, count(*) as n from {CELLS} where raw_value is not null group by all),
w as (select *, lag(n) over o as pn, lag(row_index) over o as pr from l window o as (partition by table_id order by row_index)),
m as (select *, case when n between 2 and 12 and pn = n and row_index * 10 - (pr * 10 + 8) <= 32 then 0 else 1 end as new from w),
r as (select *, sum(new) over (partition by table_id order by row_index) as run from m),
t as (select table_id, run, min(row_index) as first_line, max(row_index) as last_line, count(*)::int as n_rows from r where n between 2 and 12 group by all having count(*) >= 2)
select table_id, (row_number() over (partition by table_id order by run) - 1)::int as table_no, first_line, last_line, n_rows from t
""",
)


@query
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as lines, put together to blocks again where type, size and gaps allow it: how many each page has."""
    lines = _lines(spark, d).withColumn("type", F.col("block_type")).withColumn("level", F.lit(1)).withColumn("reading_no", F.col("line_no"))
    return layout.blocks(lines).groupBy("doc_id", "page").agg(F.count("*").alias("blocks"))


sql(
    "line_blocks",
    f"""
with w as (select *, lag(block_type) over o as pt, lag(size) over o as ps, lag(bottom) over o as pb from {PLACED} window o as (partition by doc_id, page order by line_no))
select doc_id, page, count(*) filter (pt is null or pt <> block_type or block_type in ('heading', 'title', 'list', 'caption') or abs(ps - size) > 1 or top - pb > 0.8::double * size) as blocks from w group by all
""",
)

# --- sources and sinks -----------------------------------------------------------------------------------------------


@query
def decoded_files(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text as a file's bytes, in UTF-8 with and without a mark, sniffed and decoded again."""
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    utf8 = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 2 == 0, utf8).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), utf8))
    made = rows.select(F.col("doc_id").cast("string").alias("path"), F.lit("txt").alias("extension"), F.sha2(content, 256).alias("content_hash"), content.alias("content"))
    out = files.extract(made)
    return out.select(F.col("path").cast("bigint").alias("doc_id"), F.md5("text").alias("digest"), "error")


sql("decoded_files", "select doc_id, md5(text) as digest, null::varchar as error from documents where text is not null")


@query
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk as a paragraph of HTML, and the text of that."""
    rows = table(spark, d, "chunks", "id", "text").dropDuplicates(["id"]).where("text is not null")
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><style>p {color: red}</style><body><p class='a'>"), safe, F.lit("</p><script>var x = 1 < 2;</script></body></html>"))
    squeezed = F.trim(F.regexp_replace(files.html_text(page), r"\s+", " "))
    return rows.select("id", F.md5(squeezed).alias("digest"))


sql("html_texts", r"select id, md5(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ')) as digest from (select distinct on (id) * from chunks order by id) where text is not null")


@query
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every typed table written as CSV, sniffed, parsed and typed again: the cells that hold something."""
    rows = table(spark, d, "table_cells", "id", "table_id", "row_index", "column_index", "raw_value").dropDuplicates(["id"])
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("raw_value", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = rows.groupBy("table_id", "row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_index", quoted.alias("q")))), lambda x: x["q"]), ",").alias("line"))
    texts = lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]), "\n").alias("text"))
    made = texts.select(F.col("table_id").alias("path"), F.lit("csv").alias("extension"), F.lit("").alias("content_hash"), F.encode("text", "UTF-8").alias("content"))
    read = files.extract(made).select("path", F.explode("tables").alias("t"))
    cells = typed.build_cells(read.select(F.col("path").alias("table_id"), F.lit("csv").alias("source_type"), "t.sheet_name", F.lit(None).cast("bigint").alias("page_number"), "t.rows"))
    return cells.where(F.trim("raw_value") != "").select("table_id", F.col("row_index").cast("bigint").alias("row_index"), F.col("column_index").cast("bigint").alias("column_index"), "raw_value", "value_type")


sql("csv_cells", f"select c.table_id, c.row_index, c.column_index, c.raw_value, t.value_type from {CELLS} c join ({SQL['type_cells']}) t using (id) where trim(c.raw_value, ' ') <> ''")


@query
def appended_json(spark: SparkSession, d: str) -> DataFrame:
    """Documents appended to JSON lines in two turns, and read back."""
    rows = table(spark, d, "documents", "doc_id", "lang", "n_chars", "text")
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    files.append_json(rows.where("doc_id % 2 = 0"), path)
    files.append_json(rows.where("doc_id % 2 <> 0"), path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"))


sql("appended_json", "select doc_id, lang, n_chars, md5(text) as digest from documents")


@query
def appended_csv(spark: SparkSession, d: str) -> DataFrame:
    """Typed tables' captions appended to CSV and read back."""
    rows = table(spark, d, "typed_tables", "id", "doc_id", "source_type", "row_count")
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    files.append_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", "true").csv(path)


sql("appended_csv", "select id, doc_id, source_type, row_count from typed_tables")


@query
def appended_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the table's dimension appended by kind, and counted by kind and model as they are read back."""
    rows = table(spark, d, "chunk_vectors", "id", "vector", "doc_id", "source_kind", "embedding_model_id").where("vector is not null and size(vector) = 64")
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    files.append_vectors(rows, path, 64)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("source_kind").alias("kind"), "embedding_model_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


sql("appended_vectors", "select source_kind as kind, embedding_model_id, count(*) as n, count(distinct id) as ids from chunk_vectors where vector is not null and len(vector) = 64 group by all")

# --- the store -------------------------------------------------------------------------------------------------------


@query
def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """A store's life: documents put in, some replaced, new ones joined, some deleted; a last change is taken back."""
    rows = table(spark, d, "documents", "doc_id", "status", "n_chars")
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.commit({"documents": rows.where("doc_id % 5 <> 0"), "chunks": table(spark, d, "chunks", "id", "doc_id").dropDuplicates(["id"])})
    store.upsert("documents", rows.where("doc_id % 3 = 0").withColumn("status", F.lit("ready again")), "doc_id")
    store.insert_new("documents", rows.where("doc_id % 5 = 0").withColumn("status", F.lit("new")), "doc_id")
    store.delete_documents(rows.where("doc_id % 7 = 0").select("doc_id"))
    store.commit({"documents": rows.limit(0)})
    store.rollback()
    of = store.read("chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return store.read("documents").join(of, "doc_id", "left").select("doc_id", "status", "n_chars", F.coalesce("chunks", F.lit(0)).alias("chunks"))


sql(
    "stored_documents",
    """
with c as (select doc_id, count(distinct id) as chunks from chunks group by all)
select doc_id, case when doc_id % 3 = 0 then 'ready again' when doc_id % 5 = 0 then 'new' else status end as status, n_chars, coalesce(chunks, 0) as chunks from documents left join c using (doc_id) where doc_id % 7 <> 0
""",
)


@query
def broken_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many rows break the rules of their tables."""
    chunks = violations(table(spark, d, "chunks", "id", "block_type"), ("id",), {"block_type": ("paragraph", "table")})
    return chunks.union(violations(table(spark, d, "documents", "doc_id", "doc_type"), ("doc_id",), {"doc_type": ("file",)}))


sql(
    "broken_rules",
    """
with v as (select 'unique(id)' as rule, count(*) - count(distinct id) as n from chunks union all select 'allowed(block_type)', count(*) from chunks where block_type not in ('paragraph', 'table')
  union all select 'unique(doc_id)', count(*) - count(distinct doc_id) from documents union all select 'allowed(doc_type)', count(*) from documents where doc_type <> 'file')
select * from v where n > 0
""",
)

# --- stateful streams ------------------------------------------------------------------------------------------------

ACTIONS = {"click": "start", "purchase": "succeed", "error": "fail", "view": "cancel"}


@query
def job_machine(spark: SparkSession, d: str) -> DataFrame:
    """Events as actions on their user's job: the state in which the stream leaves each job."""
    action = F.lit("retry")
    for kind, name in ACTIONS.items():
        action = F.when(F.col("event_type") == kind, name).otherwise(action)
    rows = events.event_stream(spark, d).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), action.alias("action"))
    return events.run_available(events.job_states(rows), "jobs", "update")


sql(
    "job_machine",
    f"""
with recursive a as (select user_id as job_id, row_number() over (partition by user_id order by event_id) as i, case event_type {" ".join(f"when '{k}' then '{v}'" for k, v in ACTIONS.items())} else 'retry' end as act from events),
mv(status, act, after) as (values {", ".join(f"('{s}', '{a}', '{t}')" for s, ms in events.MOVES.items() for a, t in ms.items())}),
r as (select distinct job_id, 0::bigint as i, 'queued' as status, 0 as moves from a
  union all select r.job_id, a.i, coalesce(mv.after, r.status), r.moves + (mv.after is not null)::int from r join a on a.job_id = r.job_id and a.i = r.i + 1 left join mv on mv.status = r.status and mv.act = a.act)
select job_id, arg_max(status, i) as status, arg_max(moves, i) as moves from r group by job_id
""",
)


@query
def visible_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as streams of pieces with a hidden part cut across them: what stays visible."""
    rows = events.event_stream(spark, d, "chunks").where("text is not null and not contains(lower(text), '<think')")
    pieces = F.array(F.substring("text", 1, 7), F.lit("<thi"), F.lit("nk>not to be "), F.lit("seen</thin"), F.lit("k>"), F.expr("substring(text, 8)"))
    # texts of one id are streams of their own; what comes again is dropped by its place in the stream, without a state of all texts
    stream = F.concat(F.md5("text"), F.coalesce(F.concat(F.lit(":"), "id"), F.lit("")))
    cut = rows.select(stream.alias("stream_id"), F.posexplode(pieces).alias("seq", "piece")).withColumn("last", F.col("seq") == 5)
    seen = events.run_available(events.visible_pieces(cut), "visible")
    return seen.select(F.when(F.length("stream_id") > 32, F.expr("substring(stream_id, 34)")).alias("stream_id"), F.md5("text").alias("digest"))


sql("visible_texts", "select distinct id as stream_id, md5(text) as digest from chunks where text is not null and not contains(lower(text), '<think')")


@query
def recovered_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Documents' states as jobs after a restart."""
    state = F.when(F.col("status") == "ready", "succeeded").when(F.col("status").startswith("failed"), "failed").otherwise("running")
    jobs = table(spark, d, "documents", "doc_id", "status").select(F.col("doc_id").alias("job_id"), state.alias("status"))
    return events.recovered(jobs)


sql("recovered_jobs", "select doc_id as job_id, case when status = 'ready' then 'succeeded' else 'failed' end as status from documents")
