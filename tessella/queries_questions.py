"""Queries of questions: named documents, summaries and memories, the second round, tables asked in words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import pipeline
from tessella.functions.numbers import canonical_decimal
from tessella.operators import conversations, evidence, named, retrieval
from tessella.plans import routing
from tessella.queries import CELLS, CHUNKS, CONFLICTS, LEXICAL, QUALIFIES, RERANK, SQL, STOP, SUBQUERIES, VALUE, _cells, _chunks, _questions, _sources, _stage, _words_sql, evidence_ledger, query, sql
from tessella.session import materialise
from tessella.tables import table

# --- documents that are named ----------------------------------------------------------------------------------------


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """For every query a question that names its best candidate's document."""
    best = _stage(_sources(spark, d), "rerank", "place").where("place = 1").select("query_id", "doc_id")
    names = table(spark, d, "documents", "doc_id", "display_name")
    asked = F.when(F.col("doc_id") % 2 == 0, ": which results and methods does it report?").otherwise(" as the target study.")
    return best.join(names, "doc_id").where("display_name is not null").select("query_id", F.concat(F.lit("Use “"), "display_name", F.lit("”"), asked).alias("text"))


PROMPTS = f"pr as (select query_id, display_name as title, case when doc_id % 2 = 0 then ['result', 'method'] else ['contribution', 'result', 'method', 'limitation'] end as needs from k join documents d using (doc_id) where place = 1 and display_name is not null)"


@query
def named_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = _prompts(spark, d)
    return rows.select("query_id", F.array_join(named.targets(F.col("text")), "|").alias("targets"), F.array_join(named.needs(F.col("text")), ",").alias("needs"))


sql("named_targets", f"with {RERANK}, {PROMPTS} select query_id, title as targets, array_to_string(needs, ',') as needs from pr")


@query
def named_fits(spark: SparkSession, d: str) -> DataFrame:
    """Which of a query's reranked chunks are passages of the document that its question names, and what of the question they cover."""
    prompts = _prompts(spark, d)
    needs = prompts.select("query_id", F.lit("r1").alias("requirement_id"), F.get(named.targets(F.col("text")), F.lit(0)).alias("title"), named.needs(F.col("text")).alias("needs"))
    names = table(spark, d, "documents", "doc_id", "display_name", "path")
    rows = _stage(_sources(spark, d), "rerank", "place").select("query_id", F.col("chunk_id").alias("id"), "doc_id").join(_chunks(spark, d, "text"), "id").join(names, "doc_id").select("query_id", "id", "text", F.array("display_name", "path").alias("names"))
    return named.fits(rows, needs).where("fits is not null").select("query_id", "id", F.round(F.col("fits")["r1"], 6).alias("share"))


_PLAIN = r"array_to_string(regexp_extract_all(regexp_replace(lower({0}), '\.(?:pdf|txt|md|csv|json)$', ''), '[\p{{L}}\p{{N}}_]+'), ' ')"
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 and w not in (" + ", ".join(f"'{w}'" for w in (*named.STOPWORDS, *named.KINDS)) + ")))"
_SAID = " + ".join(f"(list_contains(needs, '{n}') and regexp_matches(text, '{p}'))::int" for n, p in named.SAID.items())
sql(
    "named_fits",
    f"""
with {RERANK}, {PROMPTS},
c as (select pr.query_id, k.chunk_id as id, c.text, title, needs, list_filter([d.display_name, d.path], lambda n: n is not null and n <> '') as names from pr join k using (query_id) join {CHUNKS} c on c.id = k.chunk_id join documents d on d.doc_id = k.doc_id where c.text is not null),
m as (select *, {_TOKENS.format("title")} as own, list_distinct(flatten(list_transform(names, lambda n: {_TOKENS.format("n")}))) as known, {_PLAIN.format("title")} as plain from c),
g as (select *, (plain <> '' and len(list_filter(names, lambda n: contains({_PLAIN.format("n")}, plain))) > 0) or case when len(own) = 1 then len(list_intersect(own, known)) = 1 and length(own[1]) >= 4 else len(list_intersect(own, known)) >= 2 end as same, {QUALIFIES.format("text")} as good, ({_SAID}) / len(needs) as share from m)
select query_id, id, round(share, 6) as share from g where same and good and share >= {named.COVERED}
""",
)


@query
def ledger_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many requirements of each question are sufficient, partial, missing or conflicting."""
    return evidence.ledger_counts(evidence_ledger(spark, d))


_COUNTS = ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("sufficient", "partial", "missing", "conflicting"))
sql("ledger_counts", f"select query_id, count(*) as requirements, {_COUNTS} from ({SQL['evidence_ledger']}) group by query_id")

# --- summaries, memories, the second round ---------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Usable vectors, a row each, and as queries the children of every document whose id is divisible by 20."""
    usable = "vector is not null and size(vector) = 64 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    rows = table(spark, d, "chunk_vectors", "id", "doc_id", "vector", "parent_id", "source_kind").where(usable)
    rows = rows.groupBy(F.col("id").alias("vec_id")).agg(F.min("doc_id").alias("doc_id"), F.min("vector").alias("vector"), F.min("parent_id").alias("parent_id"), F.min("source_kind").alias("source_kind"))
    return rows.where("source_kind = 'child' and doc_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector"), rows


VECTORS = """
v as materialized (select id, min(doc_id) as doc_id, list_transform(min(vector), lambda x: x::double) as v, min(parent_id) as parent_id, min(source_kind) as kind from chunk_vectors where vector is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by id),
p as materialized (select q.id as query_id, v.id, v.parent_id, v.kind, round(greatest(list_sum(list_transform(list_zip(q.v, v.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0), 6) as d from v q, v where q.kind = 'child' and q.doc_id % 20 = 0)
"""


@query
def summary_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Children near to every query vector, fused with the places of their parents among the nearest summaries."""
    asked, rows = _vectors(spark, d)
    children = rows.where("source_kind = 'child'")
    near = retrieval.dense(asked, children.select("vec_id", "vector"), most=20)
    summaries = retrieval.summary_hits(asked, rows, 20)
    lexical = near.limit(0).select("query_id", "vec_id", F.lit(0).alias("lexical_rank"))
    fused = retrieval.fuse(near, lexical, "vec_id", parents=children.select("vec_id", "parent_id"), summaries=summaries)
    return fused.select("query_id", "vec_id", "dense_rank", "summary_rank", "fusion_score", "fusion_rank")


sql(
    "summary_fusion",
    f"""
with {VECTORS.strip()}, n as (select *, row_number() over (partition by query_id order by d, id)::int as dense_rank from p where kind = 'child'),
s0 as (select query_id, parent_id, row_number() over (partition by query_id order by d, id)::int as k from p where kind = 'summary' and parent_id is not null), s as (select query_id, parent_id, max(k) as summary_rank from s0 where k <= 6 group by all),
f as (select query_id, id as vec_id, dense_rank, summary_rank, round(1.0::double / (60 + dense_rank) + coalesce(1.0::double / (60 + summary_rank), 0), 9) as fusion_score from n left join s using (query_id, parent_id) where dense_rank <= 20)
select *, row_number() over (partition by query_id order by fusion_score desc, dense_rank, vec_id)::int as fusion_rank from f
""",
)


@query
def memory_hits(spark: SparkSession, d: str) -> DataFrame:
    """The two memories nearest to every query vector."""
    asked, rows = _vectors(spark, d)
    return retrieval.memory_hits(asked, rows).select("query_id", "vec_id", "dense_rank")


sql("memory_hits", f"with {VECTORS.strip()} select query_id, id as vec_id, k as dense_rank from (select query_id, id, row_number() over (partition by query_id order by d, id)::int as k from p where kind = 'memory') where k <= 2")


def _gaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The held-out questions with their two best lexical hits as a context, and what those leave open."""
    questions, texts = _questions(spark, d), _chunks(spark, d, "doc_id", "text").where("text is not null")
    # a few rows a question, of which all that follows is made several times over: written once, or the search would run each time
    held = materialise(retrieval.bm25(questions, texts.select("id", "text"), most=2).select("query_id", "id").join(texts, "id"), "gap-context")
    needs = evidence.requirements(questions)
    found = evidence.ledger(needs, held.select("query_id", F.col("id").alias("source_id"), "doc_id", "text"))
    return questions, held.select("query_id", "id"), found.join(needs.select("query_id", "requirement_id", "text"), ["query_id", "requirement_id"]), texts


@query
def gap_rounds(spark: SparkSession, d: str) -> DataFrame:
    """What a second round adds to the contexts of questions with open requirements."""
    return pipeline.gap_round(*_gaps(spark, d))


def _gap_sql() -> str:
    lexical = LEXICAL.strip().removeprefix("with ")
    ctes = ("w", "qt", "docs", "st", "wd", "wc", "dw", "mt", "tf", "df", "sc", "lx")
    second = lexical.replace("eval_cases where question is not null", "gq where question is not null")
    for name in ctes:  # the second search's tables by other names
        second = re.sub(rf"(?<![\w.'])({name})(?=[.\s,)]|$)", rf"g_\1", second)
    stop = ", ".join(f"'{w}'" for w in named.STOPWORDS)
    return (
        "with recursive "
        + SUBQUERIES.strip().removeprefix("with ")
        + f""", {lexical},
nd as (select item_id as query_id, id as requirement_id, text, {_words_sql("text", STOP)} as need from sq where id <> 'q0'),
ev as (select query_id, lx.id as source_id, c.doc_id, c.text from lx join {CHUNKS} c on c.id = lx.id where lexical_rank <= 2), {CONFLICTS.strip()},
hv as (select query_id, source_id, {_words_sql("text", STOP)} as have from ev),
pr as (select query_id, requirement_id, text, source_id, case when len(need) > 0 then len(list_intersect(need, have)) / len(need) else 0 end as s from nd left join hv using (query_id)),
cf as (select distinct l.query_id, l.requirement_id from cn join pr l on l.query_id = cn.query_id and l.source_id = cn.left_id and l.s > 0 join pr r on r.query_id = cn.query_id and r.source_id = cn.right_id and r.requirement_id = l.requirement_id and r.s > 0),
op as (select query_id, requirement_id, any_value(text) as text from pr group by query_id, requirement_id having coalesce(max(round(s, 6)), 0) < 0.34 or (query_id, requirement_id) in (select (query_id, requirement_id) from cf)),
tm as (select query_id, list_distinct(flatten(list(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 3 and x not in ({stop}))))) as t from op group by query_id),
gq as (select query_id as item_id, array_to_string(list_concat(t, list_filter({list(pipeline.HINTS)}, lambda h: not list_contains(t, h))), ' ') as question from tm), {second},
fr as (select g.query_id, g.id, g.lexical_score, greatest((length(c.text) + 3) // 4, 1) as n from g_lx g join {CHUNKS} c on c.id = g.id where g.lexical_rank <= 12 and not exists (select 1 from ev where ev.query_id = g.query_id and ev.source_id = g.id)),
bu as (select query_id, least(650, greatest(128, floor(coalesce(sum(greatest((length(text) + 3) // 4, 1)), 0) * 0.5)))::bigint as left_ from gq left join ev on ev.query_id = gq.item_id group by query_id),
od as (select fr.*, coalesce(bu.left_, 128) as left_, row_number() over (partition by fr.query_id order by lexical_score desc, fr.id) as i from fr left join bu using (query_id)),
rc as (select query_id, 0::bigint as i, left_::bigint as rest, 0 as k, false as took, ''::varchar as id, 0::bigint as n from od where i = 1
  union all select od.query_id, od.i, rest - case when od.n <= rest and k < 3 then od.n else 0 end, k + (od.n <= rest and k < 3)::int, od.n <= rest and k < 3, od.id, od.n from rc join od on od.query_id = rc.query_id and od.i = rc.i + 1)
select query_id, k::int as place, id, n::int as tokens from rc where took
"""
    )


sql("gap_rounds", _gap_sql())

# --- tables asked in words -------------------------------------------------------------------------------------------

SAYINGS = ("What is the average", "What is the total of the", "Which is the lowest", "Which is the highest", "How many rows has the")


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """For every typed table a question about its second column, by the name of its document."""
    tables = table(spark, d, "typed_tables", "id", "doc_id", "page_number", "table_index", "caption")
    columns = table(spark, d, "table_columns", "table_id", "column_index", "raw_header", "normalized_header")
    documents = table(spark, d, "documents", "doc_id", "display_name", "path")
    heads = columns.where("column_index = 1 and raw_header is not null").select(F.col("table_id").alias("id"), "raw_header")
    rows = tables.join(heads, "id").join(documents, "doc_id")
    saying = F.get(F.array(*[F.lit(s) for s in SAYINGS]), (F.col("doc_id") % len(SAYINGS)).cast("int"))
    text = F.concat(saying, F.lit(" "), "raw_header", F.lit(" value"), F.when(F.col("display_name").isNull(), F.lit("?")).otherwise(F.concat(F.lit(' in "'), "display_name", F.lit('"?'))))
    return rows.select(F.col("id").alias("query_id"), text.alias("text")), documents, tables, columns, _cells(spark, d)


@query
def table_routes(spark: SparkSession, d: str) -> DataFrame:
    plans = routing.plan_questions(*_asked(spark, d))
    return plans.select("query_id", "status", "reason", "operation", F.array_join("table_ids", ",").alias("tables"), "value_column")


_ROUTE_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9µμ]+'), lambda w: length(w) > 1 and w not in (" + ", ".join(f"'{w}'" for w in routing.STOPWORDS) + ")))"
_CUES = " ".join(f"when {' or '.join(f'contains(lower(text), {chr(39)}{c}{chr(39)})' for c in cues)} then '{name}'" for name, cues in routing.OPERATION_CUES)
ROUTES = f"""
dn as (select distinct on (doc_id) doc_id, display_name, path from documents where doc_id in (select doc_id from typed_tables)),
q as (select t.id as query_id, {list(SAYINGS)}[t.doc_id % {len(SAYINGS)} + 1] || ' ' || raw_header || ' value' || case when display_name is null then '?' else ' in "' || display_name || '"?' end as text, display_name as target from typed_tables t join table_columns k on k.table_id = t.id and k.column_index = 1 and raw_header is not null join documents d on d.doc_id = t.doc_id),
a as (select *, case {_CUES} else 'lookup' end as operation, {_ROUTE_WORDS.format("target")} as tw, {_ROUTE_WORDS.format("text")} as pw from (select * replace (case when length(target) >= 4 then target end as target) from q)),
dt as (select doc_id, unnest({_ROUTE_WORDS.format("concat_ws(' ', display_name, path)")}) as term from dn), wt as (select query_id, unnest(tw) as term from a where target is not null),
po as (select query_id, doc_id, sum(case when term in ({", ".join(f"'{w}'" for w in routing.GENERIC)}) then 1 else 10 end) as n from wt join dt using (term) group by all),
fi as (select query_id, min(doc_id) as doc_id from (select *, rank() over (partition by query_id order by n desc) as r from po) where r = 1 group by query_id having count(*) = 1),
pa as (select a.query_id, t.id as table_id, page_number, table_index, count(*) over (partition by a.query_id) as n_tables, list_filter(pw, lambda w: not list_contains(coalesce(tw, []), w)) as w from a join fi using (query_id) join typed_tables t using (doc_id)),
me as (select pa.query_id, pa.table_id, k.column_index, len(list_intersect({_ROUTE_WORDS.format("k.normalized_header")}, w)) as n from pa join table_columns k on k.table_id = pa.table_id),
be as (select query_id, table_id, count(*) as c, min(column_index) as col, any_value(n) as n from (select *, max(n) over (partition by query_id, table_id) as top from me) where n = top and n > 0 group by all),
so as (select pa.*, case when c > 1 then -10 else coalesce(be.n, 0) * 10 end as score, case when c = 1 then col end as col from pa left join be using (query_id, table_id)),
rk as (select *, row_number() over (partition by query_id order by score desc, coalesce(page_number, 0), table_index, table_id) as k, lead(score) over (partition by query_id order by score desc, coalesce(page_number, 0), table_index, table_id) as next from so where score > 0),
de as (select a.query_id, a.operation, case when fi.doc_id is null then 'cross_document_ambiguity' when a.operation = 'count' and rk.query_id is null then case when n.n_tables > 1 then 'ambiguous_table' end when rk.query_id is null then 'column_not_found' when rk.next = rk.score then 'ambiguous_table' when a.operation not in ('lookup', 'count') and rk.col is null then 'column_not_found' end as reason,
  coalesce(rk.table_id, n.any_) as tab, rk.col from a left join fi using (query_id) left join rk on rk.query_id = a.query_id and rk.k = 1 left join (select query_id, max(n_tables) as n_tables, any_value(table_id) as any_ from pa group by all) n on n.query_id = a.query_id)
"""
sql("table_routes", f"with {ROUTES.strip()} select query_id, case when reason is null then 'planned' else 'fallback' end as status, reason, case when reason is null then operation end as operation, case when reason is null then tab end as tables, case when reason is null then col end as value_column from de")


@query
def table_answers(spark: SparkSession, d: str) -> DataFrame:
    """What the planned questions come to."""
    asked = _asked(spark, d)
    found = routing.answer_plans(routing.plan_questions(*asked), asked[-1])
    value = F.when(F.col("operation") == "mean", canonical_decimal(F.round(F.col("value").try_cast("decimal(38,12)"), 6))).otherwise(F.col("value"))
    return found.select("query_id", "table_id", "operation", value.alias("value"), "n_cells", "status")


sql(
    "table_answers",
    f"""
with {ROUTES.strip()}, pl as (select query_id, operation, tab as table_id, col from de where reason is null),
nu as (select pl.query_id, pl.table_id, operation, c.unit, try_cast(normalized_value as decimal(38,18)) as v from pl join {CELLS} c on c.table_id = pl.table_id and c.column_index = pl.col where row_index > 0 and operation in ('min', 'max', 'sum', 'mean') and value_type in ('integer', 'decimal', 'percentage') and try_cast(normalized_value as decimal(38,18)) is not null),
ag as (select query_id, table_id, operation, count(*) as n, count(distinct coalesce(unit, '∅')) as u, case operation when 'sum' then {VALUE.format("sum(v)")} when 'min' then {VALUE.format("min(v)")} when 'max' then {VALUE.format("max(v)")} else {VALUE.format("(round(cast(sum(cast(v as decimal(38,12))) as double) / count(*), 6)::decimal(38,6))")} end as value from nu group by query_id, table_id, operation),
ct as (select pl.query_id, pl.table_id, count(distinct row_index) as n from pl left join {CELLS} c on c.table_id = pl.table_id and row_index > 0 where operation = 'count' group by all)
select pl.query_id, pl.table_id, pl.operation, case when pl.operation = 'count' then ct.n::varchar when ag.u = 1 then value end as value, case when pl.operation = 'count' then ct.n else coalesce(ag.n, 0) end as n_cells, case when pl.operation = 'count' or ag.u = 1 then 'ok' when ag.u > 1 then 'mixed_incompatible_units' else 'no_numeric_values' end as status
from pl left join ag using (query_id, table_id) left join ct using (query_id, table_id) where pl.operation in ('min', 'max', 'sum', 'mean', 'count')
""",
)


@query
def table_citations(spark: SparkSession, d: str) -> DataFrame:
    """Those answers as sources to cite, with the cells and the headers that they come from."""
    asked = _asked(spark, d)
    found = routing.answer_plans(routing.plan_questions(*asked), asked[-1])
    cited = routing.cited_results(found, asked[2], asked[1], asked[-1])
    return cited.select("query_id", "source_id", "doc_name", "kind", "table_title", F.size("cell_refs").alias("n_refs"), F.array_join("header_refs", ",").alias("header_refs"))


sql(
    "table_citations",
    f"""
with an as ({SQL["table_answers"]}), ok as (select * from an where status = 'ok'), pl as (select query_id, tables as table_id, value_column as col from ({SQL["table_routes"]}) where status = 'planned')
select ok.query_id, 'S1' as source_id, coalesce(display_name, list_last(string_split(path, '/'))) as doc_name, case when ok.operation = 'count' then 'table' else 'cell' end as kind, t.caption as table_title, case when ok.operation = 'count' then 0 else least(ok.n_cells, 24) end::int as n_refs,
  case when ok.operation = 'count' then '' else coalesce(h.cell_ref, '') end as header_refs
from ok join pl using (query_id, table_id) join typed_tables t on t.id = ok.table_id left join documents d on d.doc_id = t.doc_id left join {CELLS} h on h.table_id = ok.table_id and h.row_index = 0 and h.column_index = pl.col
""",
)

# --- conversations ---------------------------------------------------------------------------------------------------


@query
def document_tags(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the kinds of their chunks as tags."""
    tags = table(spark, d, "chunks", "doc_id", "block_type").withColumnRenamed("block_type", "tag")
    return conversations.with_tags(table(spark, d, "documents", "doc_id"), tags).select("doc_id", F.array_join("tags", ",").alias("tags"))


sql("document_tags", "select d.doc_id, coalesce(string_agg(distinct block_type, ',' order by block_type), '') as tags from documents d left join chunks c using (doc_id) group by d.doc_id")


@query
def message_sources(spark: SparkSession, d: str) -> DataFrame:
    """Queries as messages, each with its reranked sources in order."""
    rows = _sources(spark, d)
    messages = rows.select(F.col("query_id").alias("message_id")).distinct()
    sources = _stage(rows, "rerank", "rank").select(F.col("query_id").alias("message_id"), "rank", "chunk_id")
    return conversations.with_sources(messages, sources, "chunk_id").select("message_id", F.array_join(F.transform("sources", lambda s: s["chunk_id"]), ",").alias("sources"))


sql("message_sources", f"with {RERANK} select m.query_id as message_id, string_agg(chunk_id, ',' order by place) as sources from (select distinct query_id from compression_sources) m left join k using (query_id) group by m.query_id")


@query
def turn_memories(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers to their names: what would be remembered of each, without those of one source."""
    rows = table(spark, d, "documents", "doc_id", "source", "display_name", "text")
    turns = rows.select(F.coalesce("source", F.lit("-")).alias("conversation_id"), F.col("doc_id").alias("message_id"), F.col("display_name").alias("prompt"), F.col("text").alias("answer"))
    gone = turns.groupBy("conversation_id").agg(F.count("*").alias("n")).where("n > 50")
    return conversations.forgotten(conversations.memories(turns), gone).select("id", "conversation_id", "chunk_length", F.md5("text").alias("digest"))


sql(
    "turn_memories",
    r"""
with t as (select coalesce(source, '-') as conversation_id, doc_id, trim(coalesce(display_name, ''), ' ') as p, coalesce(nullif(trim(regexp_replace(text, '(?is)<think\b[^>]*>.*?(?:</think\s*>|$)', '', 'g'), ' '), ''), trim(text, ' '), '') as a from documents),
m as (select *, '[Past Conversation Context]' || chr(10) || 'User: ' || p[1:1600] || chr(10) || 'Assistant: ' || a[1:3200] as x from t)
select 'mem_' || doc_id as id, conversation_id, length(x)::int as chunk_length, md5(x) as digest from m where conversation_id not in (select coalesce(source, '-') from documents group by 1 having count(*) > 50)
""",
)


@query
def answer_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers to queries, of which every third is unknown."""
    rows = table(spark, d, "documents", "doc_id", "source", "modified_at")
    answers = rows.select(F.coalesce("source", F.lit("-")).alias("answer_id"), F.col("doc_id").alias("query_id"), F.coalesce("modified_at", F.lit("1970-01-01").cast("timestamp")).alias("created_at"))
    return conversations.answer_records(answers, rows.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("query_id"))).select("answer_id", "query_id")


sql("answer_records", "select answer_id, case when doc_id % 3 <> 0 then doc_id end as query_id from (select coalesce(source, '-') as answer_id, doc_id, row_number() over (partition by coalesce(source, '-') order by coalesce(modified_at, timestamptz '1970-01-01 00:00:00+00') desc, doc_id desc) as k from documents) where k = 1")


@query
def feedback_cases(spark: SparkSession, d: str) -> DataFrame:
    """Held-out items as feedback: those that say a question and expect a document become pending cases."""
    rows = table(spark, d, "eval_cases", "item_id", "question", "passage", "lang")
    return conversations.cases_from_feedback(rows.select(F.col("item_id").alias("feedback_id"), F.when(F.col("lang") == "en", F.col("question")).alias("question"), F.substring("passage", 1, 40).alias("correction"), F.col("lang").alias("expected_doc_id")))


sql("feedback_cases", "select * from (select item_id as feedback_id, trim(coalesce(nullif(case when lang = 'en' then question end, ''), nullif(passage[1:40], ''), ''), ' ') as question, trim(lang, ' ') as expected_doc_id, 'pending' as status from eval_cases) where question <> '' and coalesce(expected_doc_id, '') <> ''")


@query
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose files are gone or have changed, chunks' files standing in for what is there now."""
    rows = table(spark, d, "documents", "doc_id", "path", "n_chars", "modified_at", "content_hash").where("path is not null")
    rows = rows.join(rows.groupBy("path").agg(F.min("doc_id").alias("doc_id")), ["path", "doc_id"], "left_semi")
    known = rows.withColumnRenamed("n_chars", "size")
    now = rows.where("doc_id % 4 <> 0").select("path", (F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("length"), "modified_at", F.when(F.col("doc_id") % 2 == 0, F.lit("new")).otherwise(F.coalesce("content_hash", F.lit("-"))).alias("content_hash"))
    return conversations.stale_files(known, now).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


sql("stale_files", "select doc_id, case when doc_id % 4 = 0 then 'file_missing' else 'content_changed' end as reasons from (select *, row_number() over (partition by path order by doc_id) as k from documents) where k = 1 and path is not null and (doc_id % 4 = 0 or (doc_id % 3 = 0 and n_chars is not null and (case when doc_id % 2 = 0 then 'new' else coalesce(content_hash, '-') end) is distinct from content_hash))")
