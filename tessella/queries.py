"""The queries of the library's own operators, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella import pipeline
from tessella.functions import numbers as N
from tessella.functions import text as T
from tessella.operators import catalogue, chunking, evaluation, evidence, history, layout, named, retrieval, selection, typed, units
from tessella.plans.table_plan import Predicate, TablePlan, execute
from tessella.streaming import events
from tessella.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def sql(name: str, text: str) -> None:
    SQL[name] = text


# --- quantities ------------------------------------------------------------------------------------------------------


def _amounts(spark: SparkSession, d: str, trust: dict[str, float]) -> DataFrame:
    cells = table(spark, d, "table_cells", "id", "table_id", "row_index", "column_index", "raw_value", "unit")
    columns = table(spark, d, "table_columns", "table_id", "column_index", "raw_header", "inferred_unit")
    return units.common_amounts(cells, columns, table(spark, d, "typed_tables", "id", "caption", "created_at"), table(spark, d, "unit_targets"), trust=trust)


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of different tables that record one amount of a specimen in different units; a unit that is stated stands, the others are decoded."""
    return units.same_amount_pairs(_amounts(spark, d, units.STATED_STANDS))


@query
def p7_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every reading in the common unit of its quantity, in the unit that its device's level bears out."""
    return _amounts(spark, d, units.TRUST)


_PAIR_ROWS = [(q, f"{a}+{b}", sizes[a], sizes[b] / sizes[a]) for q, ps in units.PAIRED.items() for sizes in [{u[0]: u[1] for u in units.UNITS[q]}] for _, a, b in ps]
_UNIT_ROWS = ", ".join(f"('{q}', '{name}', {size!r}::double, {offset!r}::double, '{s.replace('~', ' ')}')" for q, us in units.UNITS.items() for name, size, offset, said in us for s in said.split())
_QUANTITY = "case " + " ".join(f"when regexp_matches(lower({{0}}), '{p}') then '{q}'" for q, p in units.HEADERS.items()) + " end"
# stated units only: test data have no reading that nothing states a unit for
sql(
    "p7_found",
    rf"""
with u(q, name, size, zero, said) as (values {_UNIT_ROWS}),
w(q, name, size, ratio) as (values {", ".join(f"('{q}', '{n}', {s!r}::double, {r!r}::double)" for q, n, s, r in _PAIR_ROWS)}),
c as (select distinct on (id) * from table_cells where row_index > 0 order by id),
lb as (select table_id, row_index, max(nullif(trim(raw_value, ' '), '')) as label from c where column_index = 0 group by all),
k as (select t.table_id, t.column_index, {_QUANTITY.format("raw_header")} as q, trim(regexp_extract(raw_header, '^.*(?:[(\[]|, | in |_)\s*([^()\[\]]+?)\s*[)\]]?$', 1)) as h, trim(inferred_unit) as i,
  regexp_split_to_array(regexp_extract(caption, ';\s*([^;]*)$', 1), ',\s*') as notes from table_columns t left join typed_tables y on y.id = t.table_id),
n as (select *, list_filter(notes, lambda x: {_QUANTITY.format("split_part(x, ' in ', 1)")} = q)[1] as note from k where q is not null),
ku as (select n.table_id, n.column_index, n.q, coalesce(a.name, b.name, d.name) as stated from n left join u a on a.q = n.q and a.said = h left join u b on b.q = n.q and b.said = i left join u d on d.q = n.q and d.said = trim(split_part(note, ' in ', 2))),
b as (select c.id, c.table_id, c.row_index, c.column_index, c.raw_value, ku.q, ku.stated, regexp_extract(raw_value, '{units.READING}', 1) as num, regexp_extract(raw_value, '{units.READING}', 2) || regexp_extract(raw_value, '{units.READING}', 3) as pow, regexp_extract(raw_value, '{units.READING}', 4) as said, c.unit
  from c join ku using (table_id, column_index) where c.column_index <> 0),
dc as (select table_id, column_index from b where contains(num, ',') group by all having bool_or(not regexp_matches(num, '{units.GROUPED}')) and not bool_or(regexp_matches(num, '{units.SURELY_GROUPED}'))),
v as (select b.*, label, try_cast(replace(case when not contains(num, ',') then num when dc.table_id is not null or not regexp_matches(num, '{units.GROUPED}') then replace(num, ',', '.') else replace(num, ',', '') end, '−', '-') as double) * pow(10.0, coalesce(try_cast(nullif(pow, '') as int), 0)) as val, u.name as own,
  pa.name || '+' || pb.name as pair, try_cast(regexp_extract(raw_value, '{units.TWO_UNITS}', 1) as double) as n1, try_cast(regexp_extract(raw_value, '{units.TWO_UNITS}', 3) as double) as n2
  from b join lb using (table_id, row_index) left join dc using (table_id, column_index) left join u on u.q = b.q and u.said = trim(case when b.said = '' then b.unit else b.said end)
  left join u pa on pa.q = b.q and pa.said = regexp_extract(raw_value, '{units.TWO_UNITS}', 2) left join u pb on pb.q = b.q and pb.said = regexp_extract(raw_value, '{units.TWO_UNITS}', 4) where label is not null),
o as (select v.id, v.table_id, v.label, v.q, coalesce(w.name, own, case when v.said = '' then stated end) as unit, case when w.name is not null then n1 + n2 * w.ratio else val end as val, w.size as psize from v left join w on w.q = v.q and w.name = v.pair and own is null),
m as (select o.*, val * coalesce(psize, size) + coalesce(case when psize is null then zero end, 0) as base from o left join (select distinct q, name, size, zero from u) s on s.q = o.q and s.name = o.unit where o.unit is not null and val is not null),
g as (select t.quantity as q, s.size, s.zero from unit_targets t join u s on s.q = t.quantity and s.said = t.common_unit),
r as (select m.*, coalesce((base - g.zero) / g.size, base) as amount from m left join g using (q))
select a.id as cell_a, b.id as cell_b from r a join r b on a.label = b.label and a.q = b.q and a.id < b.id and a.table_id <> b.table_id and a.unit <> b.unit and abs(a.amount - b.amount) <= 0.005 * greatest(abs(a.amount), abs(b.amount))
""",
)

# --- text ------------------------------------------------------------------------------------------------------------


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks by id; a repeated row counts once."""
    return table(spark, d, "chunks", "id", *columns).dropDuplicates(["id"])


CHUNKS = "(select distinct on (id) * from chunks order by id)"


@query
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return rows.select("doc_id", T.word_tokens(F.col("text")).alias("word_tokens"), T.char_tokens(F.col("text")).alias("char_tokens"))


sql("token_estimates", r"select doc_id, greatest(len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')), 1)::int as word_tokens, greatest((length(text) + 3) // 4, 1)::int as char_tokens from documents where text is not null")


@query
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text")
    return rows.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_no", "sentence"))


sql(
    "sentence_split",
    r"""
with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from documents where text is not null)
select doc_id, (i - 1)::int as sentence_no, l[i] as sentence from s, unnest(range(1, len(l) + 1)) t(i)
""",
)


@query
def term_sets(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "text").where("text is not null").select("id", F.array_join(F.array_sort(T.term_set(F.col("text"))), " ").alias("terms"))


STOP = "(" + ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS) + ")"
sql("term_sets", rf"select id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3 and x not in {STOP}))), ' ') as terms from {CHUNKS} where text is not null")


@query
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_cases", "item_id", "question").where("question is not null")
    return rows.select("item_id", F.array_join(F.array_sort(T.search_terms(F.col("question"))), " ").alias("terms"))


sql(
    "search_terms",
    rf"""
with w as (select item_id, list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3 and x not in {STOP}) as l from eval_cases where question is not null)
select item_id, array_to_string(list_sort(list_distinct(list_concat(l, list_transform(list_filter(l, lambda x: x like '%s' and length(x) > 4), lambda x: x[:-2])))), ' ') as terms from w
""",
)


@query
def subquery_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_cases", "item_id", "question").where("question is not null")
    return rows.select("item_id", F.explode(T.subqueries(F.col("question"))).alias("s")).select("item_id", "s.id", "s.text")


SUBQUERIES = rf"""
with c as (select item_id, trim(regexp_replace(question, '\s+', ' ', 'g')) as p from eval_cases where question is not null),
a as (select item_id, p, list_filter(list_transform(regexp_split_to_array(p, '(?i)\b(?:and|also|versus|vs\.?|compare)\b|[?;]'), lambda x: regexp_replace(x, '^[ ,;]+|[ ,;]+$', '', 'g')), lambda x: x <> '') as parts from c),
u as (select *, list_filter(parts, lambda x: not regexp_matches(lower(x), '^(?:cite|include|use|answer|respond|format)\b') and len(list_filter(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3 and w not in {STOP})) >= 2)[1:5] as good from a),
sq as (select item_id, case when len(parts) <= 1 then 'q1' else 'q0' end as id, p as text from u
  union all select item_id, 'q' || i, good[i] from u, unnest(range(1, len(good) + 1)) t(i) where len(parts) > 1 and len(good) > 1)
"""
sql("subquery_plan", SUBQUERIES + "select * from sq")


@query
def parent_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text")
    return rows.select("doc_id", F.posexplode(T.parent_chunks(F.col("text"))).alias("parent_no", "text")).withColumn("tokens", T.word_tokens(F.col("text")))


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
BLOCKS = r"list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
UNITS = rf"""
bl as (select doc_id, bi, l[bi] as block from (select doc_id, {BLOCKS} as l from documents where text is not null), unnest(range(1, len(l) + 1)) t(bi)),
ln as (select *, list_filter(list_transform(string_split(block, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from bl),
un as (select doc_id, bi, case when len(ls) > 1 and len(list_filter(ls, lambda x: regexp_matches(x, '\d') and (regexp_matches(x, '[,\t/]') or regexp_matches(x, '\s\d')))) >= greatest(2, len(ls) // 2) then ls else {SENTENCES.format("block")} end as us from ln)"""


def _parents_sql(sizes: str) -> str:
    """The SQL of parents; sizes is a query of doc_id, pt and pm, their target and most words."""
    return rf"""
with recursive {UNITS}, sz as ({sizes}),
fl as (select doc_id, bi, ui, us[ui] as u, pt, pm from un join sz using (doc_id), unnest(range(1, len(us) + 1)) t(ui)),
ws as (select *, regexp_split_to_array(u, '\s+') as w from fl),
pc as (select doc_id, bi, ui, st, pt, pm, case when len(w) > pm then array_to_string(w[st + 1:st + pm], ' ') else u end as u, case when len(w) > pm then least(pm, len(w) - st) else len(w) end as size from ws, unnest(range(0, len(w), pm)) t(st)),
nu as (select doc_id, u, size, pt, pm, row_number() over (partition by doc_id order by bi, ui, st) as i from pc),
pk as (select doc_id, i, size as n, 0 as p from nu where i = 1
  union all select nu.doc_id, nu.i, case when pk.n >= pt or pk.n + nu.size > pm then nu.size else pk.n + nu.size end, case when pk.n >= pt or pk.n + nu.size > pm then pk.p + 1 else pk.p end from pk join nu on nu.doc_id = pk.doc_id and nu.i = pk.i + 1)
select doc_id, p::int as parent_no, string_agg(u, chr(10) order by i) as text, greatest(len(regexp_extract_all(string_agg(u, chr(10) order by i), '[^ \t\n\x0b\f\r]+')), 1)::int as tokens from nu join pk using (doc_id, i) group by doc_id, p
"""


sql("parent_chunks", _parents_sql("select doc_id, 520 as pt, 650 as pm from documents"))


@query
def child_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Children of every document's parents, under the profile's sizes and overlap."""
    settings = table(spark, d, "rag_settings")
    # a document of a profile that no one has described takes the sizes that chunking has by itself
    rows = table(spark, d, "documents", "doc_id", "text", "chunking_profile").withColumn("profile", F.coalesce("chunking_profile", F.lit("default"))).join(settings, "profile", "left")
    size = lambda name, usual: F.coalesce(name, F.lit(usual))
    parents = rows.select("*", F.posexplode(T.parent_chunks(F.col("text"), size("parent_target_tokens", 520), size("parent_max_tokens", 650))).alias("parent_no", "parent"))
    return parents.select("doc_id", "parent_no", F.posexplode(T.child_chunks(F.col("parent"), size("child_target_tokens", 110), size("child_max_tokens", 150), size("child_overlap_tokens", 0))).alias("child_no", "text"))


@query
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text")
    return rows.select("doc_id", F.posexplode(T.context_blocks(F.col("text"))).alias("block_no", "b")).select("doc_id", "block_no", "b.kind", "b.text")


PARENTS = _parents_sql("select doc_id, least(parent_target_tokens, parent_max_tokens) as pt, parent_max_tokens as pm from documents join rag_settings on profile = coalesce(chunking_profile, 'default')")
sql(
    "child_chunks",
    rf"""
with recursive pr as ({PARENTS}),
bl as (select doc_id, parent_no, bi, l[bi] as block from (select doc_id, parent_no, {BLOCKS} as l from pr), unnest(range(1, len(l) + 1)) t(bi)),
ln as (select *, list_filter(list_transform(string_split(block, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from bl),
un as (select doc_id, parent_no, bi, case when len(ls) > 1 and len(list_filter(ls, lambda x: regexp_matches(x, '\d') and (regexp_matches(x, '[,\t/]') or regexp_matches(x, '\s\d')))) >= greatest(2, len(ls) // 2) then ls else {SENTENCES.format("block")} end as us from ln),
st as (select doc_id, least(child_target_tokens, child_max_tokens) as target, child_max_tokens as most, child_overlap_tokens as lap from documents join rag_settings on profile = coalesce(chunking_profile, 'default')),
fl as (select doc_id, parent_no, bi, ui, us[ui] as raw, regexp_split_to_array(us[ui], '\s+') as w, target, most, lap from un join st using (doc_id), unnest(range(1, len(us) + 1)) t(ui)),
pc as (select doc_id, parent_no, case when len(w) > most then array_to_string(w[c + 1:c + most], ' ') else raw end as u, least(most, len(w) - c) as size, target, most, lap, row_number() over (partition by doc_id, parent_no order by bi, ui, c) as i from fl, unnest(range(0, len(w), most)) t(c)),
pk as (select doc_id, parent_no, 0::bigint as i, ''::varchar as cur, 0::bigint as n, null::varchar as a, null::varchar as b from pc where i = 1
  union all select doc_id, parent_no, i, case when n2 >= target then tl else txt end, case when n2 >= target then case when tl = '' then 0 else len(string_split(tl, ' ')) end else n2 end, case when f then cur end, case when n2 >= target then txt end
    from (select *, case when lap > 0 then array_to_string(list_reverse(list_reverse(regexp_split_to_array(txt, '\s+'))[1:lap]), ' ') else '' end as tl
      from (select *, case when op = '' then u else op || ' ' || u end as txt, case when f then case when op = '' then 0 else len(string_split(op, ' ')) end else n end + size as n2
        from (select pc.doc_id, pc.parent_no, pc.i, pc.u, pc.size, pc.target, pc.lap, pk.cur, pk.n, pk.cur <> '' and pk.n + pc.size > pc.most as f,
          case when pk.cur <> '' and pk.n + pc.size > pc.most then case when pc.lap > 0 then array_to_string(list_reverse(list_reverse(regexp_split_to_array(pk.cur, '\s+'))[1:pc.lap]), ' ') else '' end else pk.cur end as op
          from pk join pc on pc.doc_id = pk.doc_id and pc.parent_no = pk.parent_no and pc.i = pk.i + 1)))),
o as (select doc_id, parent_no, i, 0 as k, a as text from pk where a is not null union all select doc_id, parent_no, i, 1, b from pk where b is not null
  union all select doc_id, parent_no, i, 2, cur from (select *, max(i) over (partition by doc_id, parent_no) as m from pk) where i = m and cur <> '')
select doc_id, parent_no, (row_number() over (partition by doc_id, parent_no order by i, k) - 1)::int as child_no, text from o
""",
)
sql(
    "context_blocks",
    rf"""
with bl as (select doc_id, bi, l[bi] as block from (select doc_id, {BLOCKS} as l from documents where text is not null), unnest(range(1, len(l) + 1)) t(bi)),
ls as (select *, list_filter(string_split(block, chr(10)), lambda x: trim(x, ' ') <> '') as ls from bl),
k as (select doc_id, bi, case when starts_with(block, '```') or len(list_filter(ls, lambda x: contains(x, chr(9)) or contains(x, '|'))) > 0 or len(list_filter(ls, lambda x: not regexp_matches(x, '^\s*(?:[-*•]|\d+[.)])\s+'))) = 0 then [block] end as whole, {SENTENCES.format("block")} as parts from ls),
e as (select doc_id, bi, ui, case when whole is not null then 'structured' else 'prose' end as kind, coalesce(whole, parts)[ui] as text from k, unnest(range(1, len(coalesce(whole, parts)) + 1)) t(ui))
select doc_id, (row_number() over (partition by doc_id order by bi, ui) - 1)::int as block_no, kind, text from e
""",
)


@query
def contextual_text(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents", "doc_id", "display_name")
    rows = _chunks(spark, d, "doc_id", "text", "section_heading", "page_number", "block_type").join(names, "doc_id")
    made = T.contextual_text(F.col("text"), F.col("display_name"), F.col("section_heading"), F.col("page_number"), F.lit(None).cast("bigint"), F.coalesce("block_type", F.lit("paragraph")))
    return rows.where("text is not null").select("id", F.md5(made).alias("digest"))


sql(
    "contextual_text",
    f"""
select c.id, md5(concat_ws(chr(10), 'Document: ' || d.display_name, 'Section: ' || nullif(section_heading, ''), 'Page: ' || page_number, 'Block type: ' || coalesce(block_type, 'paragraph')) || chr(10) || chr(10) || trim(c.text, ' ')) as digest
from {CHUNKS} c join documents d using (doc_id) where c.text is not null
""",
)


@query
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "table_cells", "id", "table_id", "row_index", "column_index").dropDuplicates(["id"])
    return rows.select("id", T.stable_id("cell", F.col("table_id"), F.col("row_index"), F.col("column_index")).alias("stable_id"))


sql("stable_ids", """select distinct id, 'cell-' || substr(sha256('["' || table_id || '","' || row_index || '","' || column_index || '"]'), 1, 24) as stable_id from table_cells""")


@query
def normalised_headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "table_columns", "id", "raw_header", "column_index").select("id", T.normalised_header(F.col("raw_header"), F.col("column_index")).alias("header"))


sql("normalised_headers", "select id, coalesce(nullif(regexp_replace(regexp_replace(lower(raw_header), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'column_' || (column_index + 1)) as header from table_columns")


@query
def preservation_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "text").where("text is not null")
    return rows.select("id", F.round(selection.preservation(F.lit("prose"), F.col("text")), 6).alias("bonus"))


sql(
    "preservation_scores",
    rf"""
select id, round(case when regexp_matches(text, '(^|[^0-9A-Za-z_-])-?\d') then 0.08 else 0 end
  + case when regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:no|not|never|without|failed to|did not|does not)([^\p{{L}}\p{{N}}_]|$)') then 0.08 else 0 end
  + case when regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:is defined as|refers to|means|we define)([^\p{{L}}\p{{N}}_]|$)') then 0.06 else 0 end, 6)::double as bonus from {CHUNKS} where text is not null
""",
)

# --- typed tables ----------------------------------------------------------------------------------------------------


def _cells(spark: SparkSession, d: str) -> DataFrame:
    names = ("id", "table_id", "row_index", "column_index", "cell_ref", "raw_value", "normalized_value", "value_type", "unit")
    return table(spark, d, "table_cells", *names).dropDuplicates(["id"])


CELLS = "(select distinct on (id) * from table_cells order by id)"
NUMBER = typed.NUMBER
CANON = r"case when regexp_matches({0}, '^-?0(\.0*)?$') then '0' else regexp_replace(regexp_replace({0}, '(\.[0-9]*?)0+$', '\1'), '\.$', '') end"
VALUE = CANON.format("cast({0} as varchar)")


@query
def type_cells(spark: SparkSession, d: str) -> DataFrame:
    """Type, unit and canonical value of every cell, from its text."""
    rows = table(spark, d, "table_cells", "id", "raw_value").dropDuplicates(["id"])
    return rows.withColumn("t", typed.typed_cell(F.col("raw_value"))).select("id", "t.normalized", "t.value_type", "t.unit")


sql(
    "type_cells",
    rf"""
with c as (select id, raw_value as raw, trim(raw_value, ' ') as t from {CELLS}),
n as (select *, case when regexp_full_match(t, '{NUMBER}') then t when regexp_full_match(t, '{NUMBER}\s*%') then regexp_extract(t, '^({NUMBER})\s*%$', 1)
  when regexp_matches(t, '{typed.WITH_UNIT}') then regexp_extract(t, '{typed.WITH_UNIT}', 1) end as num from c),
v as (select *, {VALUE.format("try_cast(replace(num, ',', '') as decimal(38,18))")} as val from n),
k as (select *, case when raw is null or t = '' then 'missing' when lower(t) in ('true', 'false') then 'boolean' when val is null then 'text'
  when regexp_full_match(t, '{NUMBER}\s*%') then 'percentage' when regexp_full_match(t, '[-+]?[0-9]+(?:,[0-9]{{3}})*') then 'integer' else 'decimal' end as value_type from v)
select id, value_type, case when value_type = 'boolean' then lower(t) when value_type in ('integer', 'decimal', 'percentage') then val when value_type = 'text' then t end as normalized,
  case when value_type = 'percentage' then '%' when value_type = 'decimal' and not regexp_full_match(t, '{NUMBER}') then nullif(regexp_extract(t, '{typed.WITH_UNIT}', 2), '') end as unit from k
""",
)


@query
def column_inference(spark: SparkSession, d: str) -> DataFrame:
    return typed.infer_columns(_cells(spark, d))


sql(
    "column_inference",
    f"""
with c as (select * from {CELLS}),
a as (select table_id, column_index, max(case when row_index = 0 then raw_value end) as raw_header,
  min(case when row_index > 0 and value_type <> 'missing' then value_type end) as lo, max(case when row_index > 0 and value_type <> 'missing' then value_type end) as hi,
  min(case when row_index > 0 and value_type <> 'missing' then nullif(unit, '') end) as u, max(case when row_index > 0 and value_type <> 'missing' then nullif(unit, '') end) as v from c group by all)
select table_id, column_index, raw_header, coalesce(nullif(regexp_replace(regexp_replace(lower(raw_header), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'column_' || (column_index + 1)) as normalized_header,
  case when lo is null then 'unknown' when lo = hi then lo else 'mixed' end as inferred_type, case when u = v then u end as inferred_unit from a
""",
)


@query
def cited_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their column's header and their header cell: two left joins."""
    cols = table(spark, d, "table_columns", "table_id", "column_index", "raw_header", "inferred_unit")
    return typed.cited_cells(_cells(spark, d), cols).select("id", "raw_header", "column_unit", "header_ref", "header_value")


sql("cited_cells", f"select c.id, k.raw_header, k.inferred_unit as column_unit, h.cell_ref as header_ref, h.raw_value as header_value from {CELLS} c left join table_columns k using (table_id, column_index) left join {CELLS} h on h.table_id = c.table_id and h.column_index = c.column_index and h.row_index = 0")


@query
def row_labels(spark: SparkSession, d: str) -> DataFrame:
    return typed.row_labels(_cells(spark, d))


sql("row_labels", f"select table_id, row_index, raw_value as row_label from {CELLS} where column_index = 0")


@query
def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    return typed.numeric_columns(_cells(spark, d))


sql("numeric_columns", f"with n as (select table_id, column_index, count(distinct row_index) as n_rows from {CELLS} where row_index > 0 and value_type in ('integer', 'decimal', 'percentage') group by all) select table_id, column_index, n_rows from (select *, row_number() over (partition by table_id order by n_rows desc, column_index) as k from n) where k = 1")


@query
def table_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each table's headers in one string, for the tables of known documents."""
    cols = table(spark, d, "table_columns", "table_id", "column_index", "raw_header")
    heads = cols.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "raw_header"))), lambda x: x["raw_header"]), " | ").alias("headers"))
    tabs = table(spark, d, "typed_tables", "id", "doc_id").withColumnRenamed("id", "table_id").join(table(spark, d, "documents", "doc_id"), "doc_id", "left_semi")
    return tabs.join(heads, "table_id", "left").select("table_id", "headers")


sql("table_texts", "select t.id as table_id, string_agg(raw_header, ' | ' order by column_index) as headers from typed_tables t left join table_columns k on k.table_id = t.id where exists (select 1 from documents d where d.doc_id = t.doc_id) group by all")

# --- table plans, each over every table ------------------------------------------------------------------------------


def _plan(name: str, plan: TablePlan, shape: Callable[[DataFrame], DataFrame], text: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shape(execute(plan, _cells(spark, d)))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = text


def _joined(*keep: str, refs: str | None = None, digits: bool = False) -> Callable[[DataFrame], DataFrame]:
    def shape(df: DataFrame) -> DataFrame:
        value = F.round(F.col("value").try_cast("double"), 6).alias("value") if digits else F.col("value")
        return df.select(*[value if k == "value" else F.col(k) for k in keep], *([F.array_join(refs, ",").alias("refs")] if refs else []))

    return shape


NUM = f"(select *, try_cast(normalized_value as decimal(38,18)) as v from {CELLS} where row_index > 0 and column_index = 2 and value_type in ('integer', 'decimal', 'percentage') and try_cast(normalized_value as decimal(38,18)) is not null)"
TABS = "(select distinct table_id from table_cells)"
_plan("plan_count", TablePlan("count", filters=(Predicate(1, "gt", "100"),)), _joined("table_id", "value", refs="verification_refs"), f"""
with c as (select * from {CELLS} where row_index > 0),
r as (select table_id, row_index from c where column_index = 1 and case when try_cast(coalesce(normalized_value, raw_value) as decimal(38,18)) is not null then try_cast(coalesce(normalized_value, raw_value) as decimal(38,18)) > 100 else lower(coalesce(normalized_value, raw_value)) > '100' end),
l as (select c.table_id, c.row_index, arg_min(cell_ref, column_index) as ref from c join r using (table_id, row_index) group by all)
select t.table_id, count(l.ref)::varchar as value, coalesce(string_agg(l.ref, ',' order by l.row_index), '') as refs from {TABS} t left join l using (table_id) group by t.table_id
""")
_plan("plan_filter", TablePlan("filter", filters=(Predicate(1, "lte", "50"), Predicate(0, "contains", "T")), limit=24), _joined("table_id", "place", "row_index", refs="row_values"), f"""
with c as (select *, coalesce(normalized_value, raw_value) as x from {CELLS} where row_index > 0),
r as (select table_id, row_index from c where column_index = 1 and case when try_cast(x as decimal(38,18)) is not null then try_cast(x as decimal(38,18)) <= 50 else lower(x) <= '50' end
  intersect select table_id, row_index from c where column_index = 0 and contains(lower(x), 't')),
k as (select *, row_number() over (partition by table_id order by row_index)::int as place from r)
select table_id, place, row_index, string_agg(raw_value, ',' order by column_index) as refs from c join k using (table_id, row_index) where place <= 24 group by all
""")
_plan("plan_lookup", TablePlan("lookup", search="kpa"), _joined("table_id", "place", "row_index", "column_index", "value", "cell_ref"), f"""
with k as (select table_id, row_number() over (partition by table_id order by row_index, column_index)::int as place, row_index, column_index, coalesce(normalized_value, raw_value) as value, cell_ref from {CELLS} where contains(lower(raw_value), 'kpa'))
select * from k where place <= 24
""")
_plan("plan_sort", TablePlan("sort", value_column=2, direction="desc", limit=5), _joined("table_id", "place", "row_index", refs="cell_refs"), f"""
with k as (select table_id, row_index, row_number() over (partition by table_id order by v desc, row_index desc)::int as place from {NUM})
select table_id, place, row_index, string_agg(c.cell_ref, ',' order by c.column_index) as refs from {CELLS} c join k using (table_id, row_index) where place <= 5 group by all
""")
for _how, _agg in (("sum", "sum(v)"), ("min", "min(v)"), ("max", "max(v)")):
    _refs = {"sum": "string_agg(cell_ref, ',' order by row_index)", "min": "arg_min(cell_ref, (v, row_index))", "max": "arg_max(cell_ref, (v, -row_index))"}[_how]
    _plan(f"plan_{_how}", TablePlan(_how, value_column=2), _joined("table_id", "value", "unit", "status", refs="cell_refs"), f"""
with a as (select table_id, {VALUE.format(_agg)} as value, count(distinct coalesce(unit, '∅')) as u, max(unit) as unit, {_refs} as refs from {NUM} group by table_id)
select t.table_id, case when u = 1 then value end as value, case when u = 1 then unit end as unit, case when u is null then 'no_numeric_values' when u > 1 then 'mixed_incompatible_units' else 'ok' end as status, case when u = 1 then refs end as refs from {TABS} t left join a using (table_id)
""")
_plan("plan_mean", TablePlan("mean", value_column=2), _joined("table_id", "value", "status", digits=True), f"""
with a as (select table_id, round(cast(sum(cast(v as decimal(38,12))) as double) / count(*), 6) as value, count(distinct coalesce(unit, '∅')) as u from {NUM} group by table_id)
select t.table_id, case when u = 1 then value end as value, case when u is null then 'no_numeric_values' when u > 1 then 'mixed_incompatible_units' else 'ok' end as status from {TABS} t left join a using (table_id)
""")
GROUPS = f"(select n.*, g.raw_value as grp, g.cell_ref as gref from {NUM} n join {CELLS} g on g.table_id = n.table_id and g.row_index = n.row_index and g.column_index = 0)"
_plan("plan_group_count", TablePlan("group", group_column=0, aggregate="count", limit=24), _joined("table_id", "place", "group", "value"), f"""
with g as (select table_id, raw_value as "group", count(*)::varchar as value from {CELLS} where row_index > 0 and column_index = 0 group by all)
select * from (select table_id, row_number() over (partition by table_id order by lower("group"), "group")::int as place, "group", value from g) where place <= 24
""")
for _how in ("sum", "mean", "min", "max"):
    _agg = {"sum": VALUE.format("sum(v)"), "mean": "round(cast(sum(cast(v as decimal(38,12))) as double) / count(*), 6)", "min": VALUE.format("min(v)"), "max": VALUE.format("max(v)")}[_how]
    _plan(f"plan_group_{_how}", TablePlan("group", group_column=0, value_column=2, aggregate=_how, limit=24), _joined("table_id", "place", "group", "value", "status", digits=_how == "mean"), f"""
with a as (select table_id, grp as "group", {_agg} as value, count(distinct coalesce(unit, '∅')) as u from {GROUPS} group by all),
k as (select table_id, row_number() over (partition by table_id order by lower("group"), "group")::int as place, "group", case when u = 1 then value end as value, case when u > 1 then 'mixed_incompatible_units' else 'ok' end as status from a)
select * from k where place <= 24
""")
for _op in ("compare", "difference", "percentage"):
    _value = {"compare": "case when l = r then 'equal' when l > r then 'greater' else 'less' end", "difference": VALUE.format("(l - r)"), "percentage": "round((cast(l as double) - cast(r as double)) / cast(r as double) * 100, 4)"}[_op]

    def _shape(df: DataFrame, op: str = _op) -> DataFrame:
        return df.select("table_id", (F.round(F.col("value").try_cast("double"), 4) if op == "percentage" else F.col("value")).alias("value"), "status")

    _plan(f"plan_{_op}", TablePlan(_op, operands=("r2c3", "r3c3")), _shape, f"""
with o as (select table_id, count(*) filter (cell_ref = 'r2c3') as nl, count(*) filter (cell_ref = 'r3c3') as nr,
  max(case when cell_ref = 'r2c3' and value_type in ('integer', 'decimal', 'percentage') then try_cast(normalized_value as decimal(38,18)) end) as l,
  max(case when cell_ref = 'r3c3' and value_type in ('integer', 'decimal', 'percentage') then try_cast(normalized_value as decimal(38,18)) end) as r,
  count(distinct coalesce(unit, '∅')) as u from {CELLS} where cell_ref in ('r2c3', 'r3c3') group by table_id),
s as (select t.table_id, l, r, case when nl is null or nl <> 1 or nr <> 1 then 'missing_or_ambiguous_operand' when l is null or r is null then 'non_numeric_operand' when u > 1 then 'mixed_incompatible_units' when {str(_op == "percentage").lower()} and r = 0 then 'division_by_zero' else 'ok' end as status from {TABS} t left join o using (table_id))
select table_id, case when status = 'ok' then {_value} end as value, status from s
""")

# --- retrieval -------------------------------------------------------------------------------------------------------


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases", "item_id", "question").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


@query
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten chunks of best BM25 for each held-out question."""
    return retrieval.bm25(_questions(spark, d), _chunks(spark, d, "text").where("text is not null"), most=10)


LEXICAL = rf"""
with w as (select item_id, list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3 and x not in {STOP}) as l from eval_cases where question is not null),
qt as (select distinct item_id as query_id, unnest(list_concat(l, list_transform(list_filter(l, lambda x: x like '%s' and length(x) > 4), lambda x: x[:-2]))) as term from w),
docs as (select id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as ws from {CHUNKS} where text is not null),
st as (select count(*) as n, avg(len(ws)) as av from docs),
wd as (select id, len(ws) as dl, unnest(ws) as word from docs), wc as (select id, dl, word, count(*) as c from wd group by all),
dw as (select distinct word from wc), mt as (select t.term, w.word from (select distinct term from qt) t join dw w on substr(w.word, 1, length(t.term)) = t.term),
tf as (select term, id, sum(c) as tf, max(dl) as dl from wc join mt using (word) group by all),
df as (select term, count(*) as df from tf group by all),
sc as (select query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) as lexical_score from qt join tf using (term) join df using (term), st group by all),
lx as (select query_id, id, lexical_score, row_number() over (partition by query_id order by lexical_score desc, id)::int as lexical_rank from sc)
"""
sql("lexical_topk", LEXICAL + "select * from lx where lexical_rank <= 10")


def _embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings", "vec_id", "embedding").withColumnRenamed("embedding", "vector")
    return rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors, by squared distance, of every vector whose id is divisible by 20."""
    asked, rows = _embeddings(spark, d)
    return retrieval.dense(asked, rows, most=10).select("query_id", "vec_id", "distance", "dense_rank")


sql(
    "dense_topk",
    """
with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings where embedding is not null),
p as (select q.vec_id as query_id, e.vec_id, round(greatest(list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0), 6) as d from e q, e where q.vec_id % 20 = 0)
select query_id, vec_id, d as distance, k::int as dense_rank from (select *, row_number() over (partition by query_id order by d, vec_id) as k from p) where k <= 10
""",
)


@query
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    return rows.select("vec_id", F.round(N.norm(F.col("embedding")), 5).alias("length"), F.round(N.norm(N.unit_vector(F.col("embedding"))), 4).alias("unit_length"))


sql("vector_norms", "with n as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), m as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as l from n) select vec_id, round(l, 5) as length, round(case when l > 0 then sqrt(list_sum(list_transform(v, lambda x: (x / l) * (x / l)))) end, 4) as unit_length from m")


@query
def label_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's cosine with the mean vector of its label."""
    rows = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    return rows.join(centres, "label").select("vec_id", "label", F.round(N.cosine(F.col("embedding"), F.col("centre")), 5).alias("similarity"))


sql(
    "label_cosines",
    """
with x as (select vec_id, label, list_transform(embedding, lambda e: e::double) as v from embeddings), u as (select label, i, avg(v[i]) as m from x, unnest(range(1, 65)) t(i) group by all),
c as (select label, list(m order by i) as c from u group by all)
select vec_id, label, round(list_sum(list_transform(list_zip(v, c), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda e: e * e))) * sqrt(list_sum(list_transform(c, lambda e: e * e)))), 5) as similarity from x join c using (label)
""",
)


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "compression_sources", "query_id", "stage", "chunk_id", "doc_id", "score").dropDuplicates(["query_id", "stage", "chunk_id"])


SOURCES = "(select distinct on (query_id, stage, chunk_id) query_id, stage, chunk_id, doc_id, score from compression_sources order by query_id, stage, chunk_id)"


def _stage(rows: DataFrame, stage: str, rank: str) -> DataFrame:
    score = F.col("score") if stage != "distance" else -F.col("score")
    at = Window.partitionBy("query_id").orderBy(score.desc(), "chunk_id")
    return rows.where(F.col("stage") == stage).select("query_id", "chunk_id", "doc_id", "score", F.row_number().over(at).alias(rank))


DENSE = f"d as (select query_id, chunk_id, doc_id, score, row_number() over (partition by query_id order by score, chunk_id)::int as dense_rank from {SOURCES} where stage = 'distance')"
BM = f"b as (select query_id, chunk_id, doc_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as lexical_rank from {SOURCES} where stage = 'bm25')"
RERANK = f"k as (select query_id, chunk_id, doc_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as place from {SOURCES} where stage = 'rerank')"
FUSION = f"fu as (select query_id, chunk_id, doc_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as place from {SOURCES} where stage = 'fusion')"


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of the distance and BM25 stages of every query."""
    rows = _sources(spark, d)
    return retrieval.fuse(_stage(rows, "distance", "dense_rank"), _stage(rows, "bm25", "lexical_rank"), "chunk_id").select("query_id", "chunk_id", "fusion_score", "fusion_rank")


RRF = f"{DENSE}, {BM}, f as (select query_id, chunk_id, dense_rank, lexical_rank, round(coalesce(1.0::double / (60 + dense_rank), 0) + coalesce(1.0::double / (60 + lexical_rank), 0), 9) as fusion_score from d full join b using (query_id, chunk_id))"
sql("rrf_fusion", f"with {RRF} select query_id, chunk_id, fusion_score, row_number() over (partition by query_id order by fusion_score desc, dense_rank asc nulls first, lexical_rank asc nulls first, chunk_id)::int as fusion_rank from f")


@query
def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all stages as if each were a subquery: best score, best ranks, who found them."""
    rows = _sources(spark, d)
    dense, lexical = _stage(rows, "distance", "dense_rank"), _stage(rows, "bm25", "lexical_rank")
    a = dense.select("query_id", F.col("chunk_id").alias("id"), (1 / (1 + F.col("score"))).alias("score"), "dense_rank", F.lit(None).cast("int").alias("lexical_rank"), F.lit("q1").alias("subquery_id"))
    b = lexical.select("query_id", F.col("chunk_id").alias("id"), "score", F.lit(None).cast("int").alias("dense_rank"), "lexical_rank", F.lit("q2").alias("subquery_id"))
    merged = retrieval.merge_candidates(a.union(b))
    return merged.select("query_id", "id", F.round("score", 6).alias("score"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"), F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"), F.array_join("subquery_ids", ",").alias("found_by"))


sql("candidate_merge", f"with {DENSE}, {BM} select query_id, chunk_id as id, round(max(s), 6) as score, coalesce(max(dr), 0)::int as dense_rank, coalesce(max(lr), 0)::int as lexical_rank, string_agg(distinct q, ',' order by q) as found_by from (select query_id, chunk_id, 1 / (1 + score) as s, dense_rank as dr, null as lr, 'q1' as q from d union all select query_id, chunk_id, score, null, lexical_rank, 'q2' from b) group by all")


@query
def prior_scores(spark: SparkSession, d: str) -> DataFrame:
    """The prior of each question's ten lexical hits."""
    questions = _questions(spark, d)
    texts = _chunks(spark, d, "text").where("text is not null")
    hits = retrieval.bm25(questions, texts, most=10).join(questions.withColumnRenamed("text", "prompt"), "query_id").join(texts, "id")
    return hits.select("query_id", "id", retrieval.prior_score(F.col("prompt"), F.col("text"), F.col("lexical_rank"), F.lit(None).cast("int")).alias("prior"))


sql(
    "prior_scores",
    LEXICAL
    + rf"""select lx.query_id, lx.id, round(greatest(0.5, 3.0::double - 0.12::double * (lexical_rank - 1)) + least(1.0::double, 0.25::double * len(list_filter(list_distinct(w.l), lambda t: contains(lower(c.text), t)))), 6) as prior
from lx join w on w.item_id = lx.query_id join {CHUNKS} c on c.id = lx.id where lexical_rank <= 10""",
)


@query
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    """The rerank stage's score blended with the prior of its ranks."""
    rows = _sources(spark, d)
    both = _stage(rows, "distance", "dense_rank").select("query_id", "chunk_id", "dense_rank").join(_stage(rows, "bm25", "lexical_rank").select("query_id", "chunk_id", "lexical_rank"), ["query_id", "chunk_id"], "full")
    both = both.join(rows.where("stage = 'rerank'").select("query_id", "chunk_id", F.col("score").alias("raw")), ["query_id", "chunk_id"], "left")
    prior = retrieval.prior_score(F.lit(""), F.lit(""), F.col("lexical_rank"), F.col("dense_rank"))
    return both.select("query_id", "chunk_id", retrieval.blended(F.col("raw"), prior).alias("score"))


sql("rerank_blend", f"with {DENSE}, {BM}, r as (select query_id, chunk_id, score as raw from {SOURCES} where stage = 'rerank'), p as (select query_id, chunk_id, raw, round(case when lexical_rank is not null then greatest(0.5, 3.0::double - 0.12::double * (lexical_rank - 1)) else 0 end + case when dense_rank is not null then greatest(0.05, 0.8::double - 0.03::double * (dense_rank - 1)) else 0 end, 6) as prior from d full join b using (query_id, chunk_id) left join r using (query_id, chunk_id)) select query_id, chunk_id, round(case when raw is null then prior else 0.75::double * raw + 0.25::double * prior end, 6) as score from p")


def _results(spark: SparkSession, d: str) -> DataFrame:
    rows = _sources(spark, d)
    lexical = _stage(rows, "bm25", "lexical_rank").select("query_id", "chunk_id", "lexical_rank")
    dense = _stage(rows, "distance", "dense_rank").select("query_id", "chunk_id", "dense_rank")
    out = _stage(rows, "rerank", "place").join(lexical, ["query_id", "chunk_id"], "left").join(dense, ["query_id", "chunk_id"], "left")
    return out.withColumnRenamed("chunk_id", "id")


@query
def relevance_window(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.relevance_window(_results(spark, d), 8).select("query_id", "id", "place")


sql(
    "relevance_window",
    f"""
with {RERANK}, {BM}, r as (select k.*, b.lexical_rank from k left join b using (query_id, chunk_id)),
m as (select *, bool_or(place <= 8 and lexical_rank is not null) over (partition by query_id) as hit, max(case when place = 1 then score end) over (partition by query_id) as top, bool_or(place <= 8 and lexical_rank is not null) over (partition by query_id, doc_id) as trusted from r),
s as (select *, row_number() over (partition by query_id order by place) as n from m where case when hit then lexical_rank is not null or trusted or score >= greatest(0.75, 0.2 * top) else place <= 8 end)
select query_id, chunk_id as id, place from s where n <= 8
""",
)


@query
def anchored_window(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.anchored_window(_results(spark, d), 6).select("query_id", "id", "window_rank")


sql("anchored_window", f"with {RERANK}, {DENSE}, r as (select k.*, d.dense_rank from k left join d using (query_id, chunk_id)) select query_id, chunk_id as id, n::int as window_rank from (select *, row_number() over (partition by query_id order by coalesce((dense_rank = 1)::int, 0) desc, score desc, chunk_id) as n from r) where n <= 6")


@query
def unused_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Reranked candidates that the window leaves out."""
    rows = _results(spark, d)
    return retrieval.unused(rows, retrieval.anchored_window(rows, 6)).select("query_id", "id")


sql("unused_candidates", f"with {RERANK}, {DENSE}, r as (select k.*, d.dense_rank from k left join d using (query_id, chunk_id)) select query_id, chunk_id as id from (select *, row_number() over (partition by query_id order by coalesce((dense_rank = 1)::int, 0) desc, score desc, chunk_id) as n from r) where n > 6")


@query
def hydrated_results(spark: SparkSession, d: str) -> DataFrame:
    """Fusion results with their document's name and their chunk's place: left joins, nothing is lost."""
    rows = _stage(_sources(spark, d), "fusion", "place")
    return rows.join(table(spark, d, "documents", "doc_id", "display_name"), "doc_id", "left").join(_chunks(spark, d, "chunk_index", "section_heading").withColumnRenamed("id", "chunk_id"), "chunk_id", "left").select("query_id", "chunk_id", "place", "display_name", "chunk_index", "section_heading")


sql("hydrated_results", f"with {FUSION} select query_id, chunk_id, place, display_name, chunk_index, section_heading from fu left join documents d on d.doc_id = fu.doc_id left join {CHUNKS} c on c.id = fu.chunk_id")


@query
def trace_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """A trace: a row per query and candidate, its score in each stage beside one another."""
    return _sources(spark, d).groupBy("query_id", "chunk_id").pivot("stage", ["distance", "bm25", "fusion", "rerank"]).agg(F.round(F.max("score"), 6))


sql("trace_by_stage", f"select query_id, chunk_id, " + ", ".join(f"round(max(case when stage = '{s}' then score end), 6) as {s}" for s in ("distance", "bm25", "fusion", "rerank")) + f" from {SOURCES} group by all")

def _words_sql(text: str, stop: str | None = None, least: int = 3) -> str:
    """The distinct terms of a text, as tessella.functions.text.term_set has them."""
    kept = f"length(x) >= {least}" + (f" and x not in {stop}" if stop else "")
    return rf"list_distinct(list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), lambda x: {kept}))"


# --- selection -------------------------------------------------------------------------------------------------------


@query
def parent_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Parents of every query's reranked chunks: how much of each was matched, and whether it is promoted."""
    matched = _stage(_sources(spark, d), "rerank", "place").select("query_id", F.col("chunk_id").alias("id"))
    return selection.parent_coverage(matched, _chunks(spark, d, "parent_id", "token_count"))


sql(
    "parent_coverage",
    f"""
with c as (select id, parent_id, greatest(coalesce(token_count, 0), 1) as t from {CHUNKS} where parent_id is not null), p as (select parent_id, sum(t)::bigint as parent_tokens from c group by all), {RERANK},
h as (select query_id, parent_id, count(*) as n_matches, sum(t)::bigint as matched_tokens from k join c on c.id = k.chunk_id group by all)
select parent_id, query_id, n_matches, matched_tokens, parent_tokens, round(least(1.0, matched_tokens / parent_tokens), 6) as coverage, n_matches >= 2 and round(least(1.0, matched_tokens / parent_tokens), 6) >= 0.4 as promoted from h join p using (parent_id)
""",
)


@query
def layout_edges(spark: SparkSession, d: str) -> DataFrame:
    """The typed neighbours of every chunk: a band join within documents."""
    rows = _chunks(spark, d, "doc_id", "chunk_index", "block_type", "section_heading", "parent_id", "page_number")
    return selection.layout_edges(rows.select("id"), rows)


LAYOUT = f"""
with c as (select * from {CHUNKS}),
p as (select a.id as id, n.id as neighbour_id, a.*, n.block_type as nb, n.section_heading as ns, n.parent_id as np, n.page_number as npg, n.chunk_index as ni, n.chunk_index - a.chunk_index as step,
  row_number() over (partition by a.id order by abs(n.chunk_index - a.chunk_index), n.chunk_index) as k from c a join c n on n.doc_id = a.doc_id and n.chunk_index between a.chunk_index - 3 and a.chunk_index + 3 and n.id <> a.id),
e as (select id, neighbour_id, step, ni, coalesce(ns = section_heading and ns <> '', false) as same, coalesce(np = parent_id, false) as kin, coalesce(abs(npg - page_number) = 1, false) as nextpage, coalesce(nb = 'table' and block_type = 'table', false) as tb, coalesce((nb = 'caption' or block_type = 'caption') and npg = page_number, false) as cap from p where k <= 12),
t as (select *, case when nextpage and (same or kin) then 'continues_on_next_page' when tb and same and step < 0 then 'table_header_for' when tb and same then 'table_continuation' when cap then 'caption_of' when abs(step) = 1 and (same or kin) then case when step > 0 then 'next_block' else 'previous_block' end when same then 'same_section' end as edge,
  case when nextpage and (same or kin) then 1 when tb and same and step < 0 then 1 when tb and same then 2 when cap then 2 when abs(step) = 1 and (same or kin) then 3 when same then 4 end as priority from e),
le as (select id, neighbour_id, edge, priority, n::int as place from (select *, row_number() over (partition by id order by priority, abs(step), ni) as n from t where edge is not null) where n <= 4)
"""
sql("layout_edges", LAYOUT + "select * from le")


@query
def layout_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Two hops around every query's reranked chunks."""
    rows = _chunks(spark, d, "doc_id", "chunk_index", "block_type", "section_heading", "parent_id", "page_number")
    anchors = _stage(_sources(spark, d), "rerank", "place").select(F.col("chunk_id").alias("id")).distinct()
    return selection.expand_layout(anchors, rows)


sql(
    "layout_expansion",
    LAYOUT
    + f""", an as (select distinct chunk_id as id from {SOURCES} where stage = 'rerank'), o as (select le.* from le join an using (id)),
b as (select id, neighbour_id, edge, 1 as hop, 0 as p, place from o union all select o.id, le.neighbour_id, le.edge, 2, o.place, le.place from o join le on le.id = o.neighbour_id where le.neighbour_id <> o.id),
f as (select * from (select *, row_number() over (partition by id, neighbour_id order by hop, p, place) as f from b) where f = 1)
select id, neighbour_id, edge, hop from (select *, row_number() over (partition by id order by hop, p, place, neighbour_id) as k from f) where k <= 6
""",
)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d).withColumn("anchor", F.coalesce(F.col("dense_rank") == 1, F.lit(False)))
    return rows.join(_chunks(spark, d, "text", "parent_id"), "id", "left")


def _needs(spark: SparkSession, d: str) -> DataFrame:
    """What a query needs, stood in for by the section that its best candidate stands under."""
    best = _stage(_sources(spark, d), "rerank", "place").where("place <= 2").join(_chunks(spark, d, "section_heading").withColumnRenamed("id", "chunk_id"), "chunk_id")
    return best.where("section_heading is not null").select("query_id", F.concat(F.lit("r"), F.col("place").cast("string")).alias("requirement_id"), F.col("section_heading").alias("text"))


@query
def coverage_selection(spark: SparkSession, d: str) -> DataFrame:
    picked = selection.select_coverage(_candidates(spark, d).select("query_id", "id", "doc_id", "parent_id", "text", "score", "lexical_rank", "anchor"), _needs(spark, d), 8)
    return picked.select("query_id", "id", "pick", "objective")


NEEDS = f"nd as (select k.query_id, 'r' || k.place as rid, section_heading as text, {_words_sql('section_heading', STOP)} as need from k join {CHUNKS} c on c.id = k.chunk_id where k.place <= 2 and section_heading is not null)"


def _picks_sql(steps: int) -> str:
    """The greedy selection, a step a pick: each looks at all that were picked before."""
    ctes = []
    for n in range(1, steps + 1):
        before = " union all ".join(f"select query_id, id from s{m}" for m in range(1, n)) or "select query_id, id from cd where false"
        ctes.append(f"""p{n} as materialized ({before}), s{n} as materialized (select query_id, id, {n}::int as pick, objective from (select *, row_number() over (partition by query_id order by objective desc, score desc, n) as rn from (
  select c.query_id, c.id, c.score, c.n, round(c.still
    + 0.38::double * coalesce((select max(gain) from gn where gn.query_id = c.query_id and gn.id = c.id and gn.rid not in (select g.rid from gn g join p{n} p on p.query_id = g.query_id and p.id = g.id where g.gain >= 0.34 and g.query_id = c.query_id)), 0)
    + case when exists (select 1 from p{n} p join cd o on o.query_id = p.query_id and o.id = p.id where p.query_id = c.query_id and o.doc_id = c.doc_id) then 0 else 0.07::double end
    + case when exists (select 1 from p{n} p join cd o on o.query_id = p.query_id and o.id = p.id where p.query_id = c.query_id and o.parent_id = c.parent_id) then 0.05::double else 0 end
    - 0.16::double * coalesce((select max(l.alike) from lk l join p{n} p on p.query_id = l.query_id and p.id = l.b where l.query_id = c.query_id and l.a = c.id), 0), 6) as objective
  from cd c where not exists (select 1 from p{n} p where p.query_id = c.query_id and p.id = c.id))) where rn = 1)""")
    return ", ".join(ctes) + " " + " union all ".join(f"select query_id, id, pick, objective from s{n}" for n in range(1, steps + 1))


sql(
    "coverage_selection",
    f"""
with {RERANK}, {BM}, {DENSE}, {NEEDS},
r0 as (select k.query_id, k.chunk_id as id, k.doc_id, c.parent_id, c.text, k.score, b.lexical_rank as lex, coalesce(d.dense_rank = 1, false) as anchor from k left join b using (query_id, chunk_id) left join d using (query_id, chunk_id) left join {CHUNKS} c on c.id = k.chunk_id),
r1 as (select *, row_number() over (partition by query_id order by score desc, id) as n from r0),
r2 as (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from r1 where n <= 100),
r3 as (select *, score >= greatest(0.05::double, 0.2::double * hi) or lex is not null or anchor as fit from r2),
cd as materialized (select *, {_words_sql("coalesce(text, '')", STOP)} as have, 0.42::double * case when hi > lo then (score - lo) / (hi - lo) else 1 end + 0.12::double * anchor::int - 0.04::double * least(greatest((length(coalesce(text, '')) + 3) // 4, 1) / 650, 1) as still
  from (select *, bool_or(fit) over (partition by query_id) as any_ from r3) where case when any_ then fit else n <= 8 end),
gn as materialized (select cd.query_id, cd.id, rid, len(list_intersect(need, have)) / greatest(len(need), 1) as gain from cd join nd using (query_id)),
lk as materialized (select a.query_id, a.id as a, b.id as b, len(list_intersect(a.have, b.have)) / greatest(len(a.have) + len(b.have) - len(list_intersect(a.have, b.have)), 1) as alike from cd a join cd b on a.query_id = b.query_id and a.id <> b.id),
{_picks_sql(8)}
""",
)


@query
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d, "parent_id", "chunk_index", "text", "token_count")
    parents = chunks.where("parent_id is not null").groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("text"), F.sum("token_count").alias("token_count"))
    picks = _stage(_sources(spark, d), "rerank", "place").select("query_id", F.col("chunk_id").alias("id"), "place")
    return selection.assemble(picks, chunks, parents)


sql(
    "context_assembly",
    f"""
with recursive {RERANK}, ch as (select id, parent_id, chunk_index, text, token_count, greatest(coalesce(token_count, 0), 1)::int as n from {CHUNKS}),
kid as (select *, row_number() over (partition by parent_id order by chunk_index, id) - 1 as pos, count(*) over (partition by parent_id) as kids from ch where parent_id is not null),
pa as (select parent_id, string_agg(text, chr(10) order by chunk_index) as text, sum(token_count) as token_count from ch where parent_id is not null group by parent_id),
pk as (select k.query_id, k.chunk_id as id, k.place, ch.parent_id, ch.text, ch.n, ch.token_count, kid.pos, kid.kids, 650 * count(*) over (partition by k.query_id) as purse from k join ch on ch.id = k.chunk_id left join kid on kid.id = ch.id),
gr as (select query_id, parent_id, any_value(purse) as purse, count(*) as m, min(place) as place, arg_min(id, place) as anchor, min(pos) as low, max(pos) as high, sum(n) as held, any_value(kids) as kids from pk where parent_id is not null group by all having count(*) >= 2),
w1 as (select gr.*, pa.text as whole, greatest(coalesce(pa.token_count, 0), 1) as wn, high - low + 1 as len, low > 0 and high - low + 2 <= 5 as l from gr join pa using (parent_id)),
w2 as (select *, high < kids - 1 and len + l::int + 1 <= 5 as r from w1),
w3 as (select *, low - l::int as f, high + r::int as t from w2),
w4 as (select w3.*, sum(kid.n) filter (kid.pos between f and t) as wide, sum(kid.n) filter (kid.pos between low and high) as narrow from w3 join kid using (parent_id) group by all),
w5 as (select *, row_number() over (partition by query_id order by place) as i, case when whole is not null and held >= 0.4::double * wn and wn <= 650 then wn end as aw, case when len <= 5 then wide end as ww, case when len <= 5 then narrow end as wr from w4),
sp as (select query_id, 0::bigint as i, purse::hugeint as rest, null::varchar as form, null::varchar as parent_id, 0::hugeint as cost from w5 where i = 1
  union all select w5.query_id, w5.i, rest - (case when aw <= rest then aw when ww <= least(650, rest) then ww when wr <= least(650, rest) then wr else 0 end), case when aw <= rest then 'parent' when ww <= least(650, rest) then 'wide' when wr <= least(650, rest) then 'narrow' end, w5.parent_id,
    case when aw <= rest then aw when ww <= least(650, rest) then ww when wr <= least(650, rest) then wr else 0 end from sp join w5 on w5.query_id = sp.query_id and w5.i = sp.i + 1),
un as (select w5.*, sp.form, sp.cost from sp join w5 using (query_id, i) where form is not null),
ut as (select un.query_id, un.parent_id, anchor, case when form = 'parent' then 'parent' else 'sibling_span' end as kind, cost, any_value(whole) as whole, list(kid.id order by kid.pos) as ids, string_agg(coalesce(kid.text, ''), chr(10) || chr(10) order by kid.pos) as span, any_value(form) as form
  from un join kid on kid.parent_id = un.parent_id and (form = 'parent' or (form = 'wide' and kid.pos between f and t) or (form = 'narrow' and kid.pos between low and high)) group by un.query_id, un.parent_id, anchor, form, cost)
select pk.query_id, row_number() over (partition by pk.query_id order by place, id)::int as place, id as anchor_id, coalesce(kind, 'child') as kind, parent_id, coalesce(ids, [id]) as chunk_ids, case when kind is null then text when form = 'parent' then whole else span end as text,
  coalesce(cost, greatest(coalesce(nullif(token_count, 0), (length(coalesce(text, '')) + 3) // 4), 1))::int as tokens from pk left join ut using (query_id, parent_id) where anchor is null or anchor = id
""",
)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of every query's reranked sources; its question is stood in for by the headings of its best candidates."""
    rows = _stage(_sources(spark, d), "rerank", "place").join(_chunks(spark, d, "text").withColumnRenamed("id", "chunk_id"), "chunk_id").where("text is not null")
    prompts = _needs(spark, d).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("prompt"))
    blocks = rows.select("query_id", F.col("chunk_id").alias("source_id"), F.col("place").alias("source_rank"), F.col("score").alias("source_score"), F.posexplode(T.context_blocks(F.col("text"))).alias("block_no", "b"))
    blocks = blocks.join(prompts, "query_id", "left").withColumn("prompt", F.coalesce("prompt", F.lit("")))
    score = selection.block_score(F.col("prompt"), F.col("b.kind"), F.col("b.text"), F.col("source_score"), F.col("source_rank"))
    relevant = F.size(F.array_intersect(T.term_set(F.col("prompt")), T.term_set(F.col("b.text")))) > 0
    return blocks.select("query_id", "source_id", "source_rank", "block_no", F.col("b.text").alias("text"), F.round(score, 9).alias("score"), relevant.alias("relevant"))


@query
def context_compression(spark: SparkSession, d: str) -> DataFrame:
    return selection.compress(_blocks(spark, d), _needs(spark, d))


BONUS = r"""case when regexp_matches({0}, '(^|[^0-9A-Za-z_])-?\d') then 0.08::double else 0 end + case when regexp_matches({0}, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:no|not|never|without|failed to|did not|does not)([^\p{{L}}\p{{N}}_]|$)') then 0.08::double else 0 end
  + case when regexp_matches({0}, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:is defined as|refers to|means|we define)([^\p{{L}}\p{{N}}_]|$)') then 0.06::double else 0 end"""
SCORED = rf"""
{RERANK}, {NEEDS}, pm as (select query_id, {_words_sql("string_agg(text, ' ' order by text)", STOP)} as asked from nd group by query_id),
sr as (select k.query_id, k.chunk_id as source_id, k.place, k.score as ss, c.text from k join {CHUNKS} c on c.id = k.chunk_id where c.text is not null),
b1 as (select query_id, source_id, place, ss, bi, l[bi] as block from (select *, {BLOCKS} as l from sr), unnest(range(1, len(l) + 1)) t(bi)),
b2 as (select *, list_filter(string_split(block, chr(10)), lambda x: trim(x, ' ') <> '') as ls from b1),
b3 as (select *, case when starts_with(block, '```') or len(list_filter(ls, lambda x: contains(x, chr(9)) or contains(x, '|'))) > 0 or len(list_filter(ls, lambda x: not regexp_matches(x, '^\s*(?:[-*•]|\d+[.)])\s+'))) = 0 then [block] end as whole, {SENTENCES.format("block")} as parts from b2),
b4 as (select query_id, source_id, place, ss, whole is not null as structured, coalesce(whole, parts)[ui] as text, row_number() over (partition by query_id, source_id order by bi, ui) - 1 as block_no from b3, unnest(range(1, len(coalesce(whole, parts)) + 1)) t(ui)),
b5 as (select b4.*, coalesce(asked, []) as asked, {_words_sql("b4.text", STOP)} as have from b4 left join pm using (query_id)),
b6 as materialized (select *, round(case when len(asked) = 0 or len(have) = 0 then 0 else len(list_intersect(asked, have)) / (len(asked) + len(have) - len(list_intersect(asked, have))) end + 0.08::double * ss + 0.04::double / place + case when structured then 0.12::double else 0 end + {BONUS.format("text")}, 9) as score,
  row_number() over (partition by query_id order by place, source_id, block_no) as n from b5)
"""


def _kept_sql(steps: int) -> str:
    """The greedy compression, a step a block."""
    ctes = []
    for m in range(1, steps + 1):
        before = " union all ".join(f"select query_id, n from c{j}" for j in range(1, m)) or "select query_id, n from bb where false"
        ctes.append(f"""k{m} as materialized (select x.query_id, bb.n, bb.source_id, bb.have from ({before}) x join bb using (query_id, n)),
t{m} as materialized (select query_id, list_distinct(flatten(list(have))) as seen from k{m} group by query_id), u{m} as materialized (select distinct g.query_id, g.rid from gg g join k{m} k on k.query_id = g.query_id and k.n = g.n where g.gain >= 0.34),
v{m} as (select b.*, coalesce(len(list_intersect(b.have, t.seen)), 0) / greatest(len(b.have), 1) as known, not exists (select 1 from k{m} k where k.query_id = b.query_id and k.source_id = b.source_id) as fresh,
  coalesce((select max(gain) from gg g where g.query_id = b.query_id and g.n = b.n and not exists (select 1 from u{m} u where u.query_id = g.query_id and u.rid = g.rid)), 0) as gain from bb b left join t{m} t on t.query_id = b.query_id where not exists (select 1 from k{m} k where k.query_id = b.query_id and k.n = b.n)),
c{m} as materialized (select query_id, n, {m}::int as place, source_id, text, round(value, 6) as value from (select *, row_number() over (partition by query_id order by value desc, score desc, n) as rn from (select *, score + 0.45::double * gain + 0.2::double * fresh::int - 0.28::double * known as value from v{m} where {m} = 1 or known <= 0.75 or fresh or gain >= 0.34)) where rn = 1)""")
    return ", ".join(ctes) + " " + " union all ".join(f"select query_id, place, source_id, text, value from c{m}" for m in range(1, steps + 1))


sql(
    "context_compression",
    f"with {SCORED.strip()}, bb as materialized (select * from b6 where n <= 320), gg as materialized (select bb.query_id, bb.n, rid, len(list_intersect(need, have)) / greatest(len(need), 1) as gain from bb join nd using (query_id)), {_kept_sql(10)}",
)


@query
def plain_compression(spark: SparkSession, d: str) -> DataFrame:
    return selection.compress_plainly(_blocks(spark, d))


PLAINLY = f"""
{SCORED.strip()}, po as (select *, row_number() over (partition by query_id order by score desc, n) as o from b6),
pl as (select query_id, 1::bigint as o, 1 as k, have as seen, true as took from po where o = 1
  union all select po.query_id, po.o, k + (k < 10 and len(list_intersect(po.have, seen)) / greatest(len(po.have), 1) <= 0.75)::int, case when k < 10 and len(list_intersect(po.have, seen)) / greatest(len(po.have), 1) <= 0.75 then list_distinct(list_concat(seen, po.have)) else seen end, k < 10 and len(list_intersect(po.have, seen)) / greatest(len(po.have), 1) <= 0.75
  from pl join po on po.query_id = pl.query_id and po.o = pl.o + 1)
"""
sql("plain_compression", f"with recursive {PLAINLY.strip()} select pl.query_id, k::int as place, source_id, text from pl join po using (query_id, o) where took")


@query
def compression_stats(spark: SparkSession, d: str) -> DataFrame:
    """How much of every query's evidence is relevant, and how many blocks plain compression keeps."""
    blocks = _blocks(spark, d)
    return selection.compression_stats(blocks, selection.compress_plainly(blocks))


sql(
    "compression_stats",
    f"with recursive {PLAINLY.strip()}, kp as (select query_id, count(*) as kept from pl where took group by query_id) select query_id, count(*) as input_blocks, any_value(kept) as kept_blocks, count(*) filter (len(list_intersect(asked, have)) > 0) as relevant_blocks, round(count(*) filter (len(list_intersect(asked, have)) > 0) / count(*), 6) as relevance from b6 join kp using (query_id) group by query_id",
)


@query
def layout_budget(spark: SparkSession, d: str) -> DataFrame:
    """Two hops around every query's assembled context, within a quarter of its tokens."""
    chunks = _chunks(spark, d, "doc_id", "chunk_index", "block_type", "section_heading", "parent_id", "page_number", "text", "token_count")
    return selection.expand_within(context_assembly(spark, d), chunks)


sql(
    "layout_budget",
    LAYOUT.strip().replace("with c as", "with recursive c as", 1)
    + f""", ca as ({SQL["context_assembly"]}), pu as (select query_id, floor(sum(greatest(tokens, 1)) * 0.25)::bigint as purse from ca group by query_id),
st as (select id, '' as via, neighbour_id as nb, edge, 1 as hop, 0 as p, place as k from le union all select o.id, o.neighbour_id, t.neighbour_id, t.edge, 2, o.place, t.place from le o join le t on t.id = o.neighbour_id),
wk as (select ca.query_id, ca.place, anchor_id as id, via, nb, edge, hop, greatest(coalesce(nullif(x.token_count, 0), (length(x.text) + 3) // 4), 1) as n, row_number() over (partition by ca.query_id order by ca.place, hop, p, st.k, anchor_id, via, nb) as i
  from ca join st on st.id = ca.anchor_id join {CHUNKS} x on x.id = nb where not list_contains(list_concat(chunk_ids, [anchor_id]), nb)),
fd as (select query_id, 0::bigint as i, purse as rest, []::varchar[] as met, []::varchar[] as got, false as took from wk join pu using (query_id) where i = 1
  union all select query_id, i, rest - case when fits then n else 0 end, case when fresh then list_append(met, place || '|' || nb) else met end, case when fits then list_append(got, id || '|' || nb) else got end, fits
  from (select *, fresh and n <= rest and len(list_filter(got, lambda g: starts_with(g, id || '|'))) < 6 as fits
    from (select wk.*, fd.rest, fd.met, fd.got, (hop = 1 or list_contains(fd.got, wk.id || '|' || via)) and not list_contains(fd.met, wk.place || '|' || nb) as fresh from fd join wk on wk.query_id = fd.query_id and wk.i = fd.i + 1)))
select wk.query_id, wk.id as anchor_id, nb as neighbour_id, edge, hop, n::int as tokens from fd join wk using (query_id, i) where took
""",
)

# --- evidence --------------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents that cite stand for answers; the chunks of their document, as S0, S1 and so on, for the sources."""
    answers = table(spark, d, "documents", "doc_id", "text").where(F.col("text").contains("[[src:")).withColumnRenamed("doc_id", "answer_id")
    chunks = _chunks(spark, d, "doc_id", "chunk_index", "text").join(answers.select(F.col("answer_id").alias("doc_id")), "doc_id", "left_semi")
    return answers, chunks.select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("S"), F.col("chunk_index").cast("string")).alias("source_id"), "text", "doc_id")


@query
def citation_accounting(spark: SparkSession, d: str) -> DataFrame:
    answers, sources = _answers(spark, d)
    return evidence.citation_accounting(answers, sources)


sql(
    "citation_accounting",
    rf"""
with a as (select doc_id as answer_id, list_transform(regexp_extract_all(text, '(?i)\[\[\s*src\s*:\s*([A-Za-z0-9_-]+)\s*\]\]', 1), lambda x: upper(x)) as tags, len(regexp_extract_all(text, '(?i)\[\[?\s*src\s*:[^\]]*\]?\]')) as lk from documents where contains(text, '[[src:')),
s as (select doc_id as answer_id, list(distinct 'S' || chunk_index) as have from {CHUNKS} group by all),
b as (select answer_id, tags, lk, list_distinct(tags) as ids, coalesce(have, []) as have from a left join s using (answer_id)),
v as (select *, len(list_filter(ids, lambda x: list_contains(have, x))) as ok from b)
select answer_id, len(tags)::int as citation_count, len(ids)::int as unique_count, ok::int as valid_count, (len(ids) - ok)::int as invalid_count,
  array_to_string(list_sort(list_filter(ids, lambda x: len(list_filter(tags, lambda t: t = x)) > 1)), ',') as repeated_ids, (lk - len(tags))::int as malformed_count, (len(have) - ok)::int as uncited_count, case when len(ids) = 0 then 0.0 else round(ok / len(ids), 6) end as precision from v
""",
)


CLAIM_STOP = "(" + ", ".join(f"'{w}'" for w in evidence.CLAIM_STOPWORDS) + ")"
NEGATIVE = r"regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(?:no|not|never|neither|without|failed to|did not|does not|was not|were not)([^\p{L}\p{N}_]|$)')"
_UNIT_CASES = " ".join(f"when '{k}' then '{v}'" for k, v in evidence.UNIT_NAMES.items())
_CLAIM_WORDS = rf"list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_.-]+'), lambda x: length(x) >= 3 and x not in {CLAIM_STOP}), lambda x: case when length(x) > 6 and regexp_full_match(x, '\p{{L}}+') then x[1:6] else x end))"
#: cn: the conflicts among the sources of ev (query_id, source_id, doc_id, text), by looking at all pairs of a query
CONFLICTS = rf"""
es as (select distinct query_id, source_id, doc_id, {_CLAIM_WORDS} as t, {NEGATIVE} as neg, list_filter(list_transform(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_.-])(-?\d+(?:\.\d+)?(?:\s*(?:%|[a-zA-Zµμ°]+))?)', 1),
  lambda m: {{'v': regexp_extract(m, '^(-?\d+(?:\.\d+)?)', 1)::double, 'u': replace(regexp_extract(m, '^-?\d+(?:\.\d+)?\s*(.*)$', 1), 'μ', 'µ')}}), lambda x: x.u <> '') as v from ev where text is not null),
en as (select * exclude v, list_transform(v, lambda x: {{'v': x.v, 'u': case when regexp_full_match(x.u, '\p{{L}}') then x.u else case lower(x.u) {_UNIT_CASES} else lower(x.u) end end}}) as v from es),
cp as (select a.query_id, a.source_id as left_id, b.source_id as right_id, a.neg <> b.neg as opposite, a.v as x, b.v as y from en a join en b on a.query_id = b.query_id and a.source_id < b.source_id and a.doc_id <> b.doc_id and len(a.t) > 0 and len(b.t) > 0
  where len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.45),
cn as (select query_id, left_id, right_id, case when opposite then 'negation' else 'values' end as reason from cp where opposite
  or len(list_filter(x, lambda p: len(list_filter(y, lambda q: q.u = p.u)) > 0 and len(list_filter(y, lambda q: q.u = p.u and abs(p.v - q.v) <= greatest(1e-9, abs(p.v) * 0.001))) = 0)) > 0
  or len(list_filter(y, lambda p: len(list_filter(x, lambda q: q.u = p.u)) > 0 and len(list_filter(x, lambda q: q.u = p.u and abs(p.v - q.v) <= greatest(1e-9, abs(p.v) * 0.001))) = 0)) > 0)
"""


_NUMBERS = rf"""list_transform(regexp_extract_all({{0}}, '(?:^|[^0-9A-Za-z_.-])(-?\d+(?:\.\d+)?(?:\s*(?:%|[a-zA-Zµμ°]+))?)', 1)[1:32], lambda m: {{{{'v': regexp_extract(m, '^(-?\d+(?:\.\d+)?)', 1)::double, 'u': replace(regexp_extract(m, '^-?\d+(?:\.\d+)?\s*(.*)$', 1), 'μ', 'µ')}}}})"""
_NAMED_NUMBERS = rf"list_transform({{0}}, lambda x: {{{{'v': x.v, 'u': case when regexp_full_match(x.u, '\p{{{{L}}}}') then x.u else case lower(x.u) {_UNIT_CASES} else lower(x.u) end end}}}})"
_TAG = r"\[\[\s*src\s*:\s*[A-Za-z0-9_-]+\s*\]\]"
CLAIMS = rf"""
an as (select doc_id as answer_id, trim(regexp_replace(text, '(?is)<think\b[^>]*>.*?(?:</think\s*>|$)', '', 'g'), ' ') as t from documents where contains(text, '[[src:')),
jn as (select answer_id, regexp_replace(regexp_replace(t, '(?i)([.!?])\s+((?:{_TAG}\s*)+)', '\1 \2' || chr(10), 'g'), '(?i)([.!?])\s(\[\[\s*src\s*:)', '\1' || chr(1) || '\2', 'g') as t from an),
pt as (select answer_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(2), 'g'), '\n+', chr(2), 'g'), chr(2)), lambda x: replace(x, chr(1), ' ')), lambda x: trim(x, ' ') <> '')[1:32] as l from jn),
c0 as (select answer_id, i, regexp_replace(regexp_replace(l[i], '(?i){_TAG}', '', 'g'), '^[ *#\t-]+|[ *#\t-]+$', '', 'g') as text, list_transform(regexp_extract_all(l[i], '(?i)\[\[src:\s*([A-Za-z0-9_-]+)\s*\]\]', 1), lambda x: upper(x)) as tags from pt, unnest(range(1, len(l) + 1)) t(i)),
c1 as materialized (select answer_id, i, text, list_filter(tags, lambda x, k: list_position(tags, x) = k) as ids, {_CLAIM_WORDS} as terms, {NEGATIVE} as neg from c0),
cl as materialized (select * from c1 where len(terms) >= 2),
sc as materialized (select distinct on (answer_id, source_id) *, {_CLAIM_WORDS} as terms, {NEGATIVE} as neg from (select doc_id as answer_id, upper('S' || chunk_index) as source_id, coalesce(text, '') as text from {CHUNKS}) order by answer_id, source_id),
me as (select cl.answer_id, cl.i, tag_no, s.text as e, case when s.text is not null then len(list_intersect(cl.terms, s.terms)) / len(cl.terms) end as shared,
  case when s.text is not null and len(s.terms) > 0 then len(list_intersect(cl.terms, s.terms)) / (len(cl.terms) + len(s.terms) - len(list_intersect(cl.terms, s.terms))) >= 0.45 and cl.neg <> s.neg end as opposite from cl, unnest(range(1, len(ids) + 1)) t(tag_no) left join sc s on s.answer_id = cl.answer_id and s.source_id = cl.ids[tag_no]),
gr as (select answer_id, i, max(coalesce(shared, 0)) as cover, bool_or(e is null) as unknown, bool_or(coalesce(opposite, false)) as negated, coalesce(string_agg(e, chr(10) order by tag_no), '') as e from me group by all),
nm as (select cl.*, coalesce(cover, 0) as cover, coalesce(unknown, false) as unknown, coalesce(negated, false) as negated, coalesce(e, '') as e, lower(cl.text) as low, {_NAMED_NUMBERS.format(_NUMBERS.format("cl.text"))} as said, {_NAMED_NUMBERS.format(_NUMBERS.format("coalesce(e, '')"))} as has from cl left join gr using (answer_id, i)),
n1 as (select *, list_filter(has, lambda x: x.u <> '') as named from nm),
n2 as (select *, list_filter(named, lambda x: x.u <> '%' and len(list_filter(named, lambda y: y.u = x.u)) >= 2) as pa, list_filter(named, lambda x: len(list_filter(named, lambda y: y.u = x.u)) >= 2) as pb from n1),
n3 as (select *, list_filter(pa, lambda x: x.u = pa[1].u) as ta, list_filter(pb, lambda x: x.u = pb[1].u) as tb from n2),
n4 as materialized (select *, case when abs(ta[1].v) > 1e-6 then abs(ta[1].v - ta[2].v) / abs(ta[1].v) when abs(ta[2].v) > 1e-6 then abs(ta[1].v - ta[2].v) / abs(ta[2].v) end * 100 as change, tb[2].v - tb[1].v as delta from n3),
ck as (select answer_id, i, x, low, change, list_transform(list_filter(has, lambda y: y.u = x.u), lambda y: y.v) as vs from (select *, unnest(said) as x from n4)),
cd as (select *, case when x.u = '%' and change is not null then change when len(vs) >= 2 and regexp_matches(low, '\b(?:difference|differed|gap)\b') then abs(vs[1] - vs[2]) when len(vs) >= 1 and regexp_matches(low, '\b(?:average|mean)\b') then list_sum(vs) / len(vs) when len(vs) >= 1 and regexp_matches(low, '\b(?:sum|total)\b') then list_sum(vs) end as derived from ck),
cw as (select answer_id, i, max(case when len(list_filter(vs, lambda v: abs(x.v - v) <= greatest(1e-6, abs(x.v) * 0.01))) > 0 then 1 when derived is not null then case when abs(x.v - derived) <= greatest(1e-6, abs(x.v) * 0.01) then 1 else 3 end when len(vs) > 0 then 3 else 2 end) as worst from cd group by all),
cs as (select n4.*, case when len(said) = 0 then 'not_applicable' when worst = 3 or coalesce(contains(lower(e), 'from') and contains(lower(e), ' to ') and (((regexp_matches(low, '\b(?:decreas\w*|reduc\w*|lower\w*|faster)\b') or (contains(low, 'improv') and regexp_matches(low, '\b(?:latency|time|error|loss)\b'))) and delta > 0)
  or (regexp_matches(low, '\b(?:increas\w*|higher\w*|grew|slower)\b') and delta < 0)), false) then 'contradicted' when worst = 2 then 'unsupported' else 'entailed' end as numeric_status from n4 left join cw using (answer_id, i)),
cv as (select answer_id, 'C' || i as claim_id, text, array_to_string(ids, ',') as source_ids, round(cover, 6) as coverage, numeric_status, case when len(ids) = 0 then 'citation_missing' when unknown then 'unsupported' when numeric_status = 'contradicted' or negated then 'contradicted' when numeric_status = 'unsupported' then 'unsupported' when round(cover, 6) >= 0.55 then 'entailed' when round(cover, 6) >= 0.25 then 'partially_entailed' else 'unsupported' end as status from cs)
"""


@query
def claim_verification(spark: SparkSession, d: str) -> DataFrame:
    answers, sources = _answers(spark, d)
    claims = evidence.verify_claims(answers, sources)
    return claims.select("answer_id", "claim_id", "text", F.array_join("source_ids", ",").alias("source_ids"), "coverage", "numeric_status", "status")


sql("claim_verification", f"with {CLAIMS.strip()} select * from cv")


@query
def claim_summary(spark: SparkSession, d: str) -> DataFrame:
    answers, sources = _answers(spark, d)
    return evidence.claim_summary(evidence.verify_claims(answers, sources))


sql("claim_summary", f"with {CLAIMS.strip()} select answer_id, count(*) as claim_count, " + ", ".join(f"count(*) filter (status = '{x}') as {x}" for x in ("entailed", "partially_entailed", "unsupported", "contradicted", "citation_missing")) + " from cv group by answer_id")


@query
def evidence_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What each requirement of a question finds among the question's lexical hits."""
    questions, texts = _questions(spark, d), _chunks(spark, d, "doc_id", "text").where("text is not null")
    hits = retrieval.bm25(questions, texts.select("id", "text"), most=8).join(texts, "id").select("query_id", F.col("id").alias("source_id"), "doc_id", "text")
    return evidence.ledger(evidence.requirements(questions), hits)


sql(
    "evidence_ledger",
    SUBQUERIES.rstrip()
    + rf""", {LEXICAL.strip().removeprefix("with ")}, nd as (select item_id as query_id, id as requirement_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3 and x not in {STOP})) as need from sq where id <> 'q0'),
hv as (select query_id, lx.id as source_id, list_distinct(list_filter(regexp_extract_all(lower(c.text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3 and x not in {STOP})) as have from lx join {CHUNKS} c on c.id = lx.id where lexical_rank <= 8),
pr as (select query_id, requirement_id, source_id, case when len(need) > 0 then len(list_intersect(need, have)) / len(need) else 0 end as s from nd join hv using (query_id)),
gr as (select query_id, requirement_id, least(count(*), 4) as n, round(max(s), 6) as b from pr where s > 0 group by all),
ev as (select query_id, lx.id as source_id, c.doc_id, c.text from lx join {CHUNKS} c on c.id = lx.id where lexical_rank <= 8), {CONFLICTS},
cf as (select distinct l.query_id, l.requirement_id from cn join pr l on l.query_id = cn.query_id and l.source_id = cn.left_id and l.s > 0 join pr r on r.query_id = cn.query_id and r.source_id = cn.right_id and r.requirement_id = l.requirement_id and r.s > 0)
select query_id, requirement_id, coalesce(n, 0) as n_evidence, coalesce(b, 0) as best, case when exists (select 1 from cf where cf.query_id = nd.query_id and cf.requirement_id = nd.requirement_id) then 'conflicting' when coalesce(b, 0) >= 0.34 then 'sufficient' when coalesce(b, 0) > 0 then 'partial' else 'missing' end as status from nd left join gr using (query_id, requirement_id)
""",
)


@query
def evidence_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts among every query's reranked sources, and among the twenty lexical hits of every held-out question."""
    texts = _chunks(spark, d, "doc_id", "text").where("text is not null")
    reranked = _stage(_sources(spark, d), "rerank", "place").select("query_id", F.col("chunk_id").alias("id"))
    hits = retrieval.bm25(_questions(spark, d), texts.select("id", "text"), most=20).select("query_id", "id")
    return evidence.conflicts(reranked.union(hits).join(texts, "id").select("query_id", F.col("id").alias("source_id"), "doc_id", "text"))


sql(
    "evidence_conflicts",
    LEXICAL + f", {RERANK}, ev as (select query_id, id as source_id, c.doc_id, c.text from (select query_id, chunk_id as id from k union all select query_id, id from lx where lexical_rank <= 20) join {CHUNKS} c using (id)), {CONFLICTS.strip()} select * from cn",
)


@query
def citation_support(spark: SparkSession, d: str) -> DataFrame:
    rows = _sources(spark, d)
    fusion = rows.where("stage = 'fusion'").select("query_id", "chunk_id", F.col("score").alias("f"))
    both = fusion.join(rows.where("stage = 'rerank'").select("query_id", "chunk_id", F.col("score").alias("r")), ["query_id", "chunk_id"], "left")
    return both.select("query_id", "chunk_id", evidence.citation_support(F.col("r"), F.col("f")).alias("support"))


sql("citation_support", f"with f as (select query_id, chunk_id, score as f from {SOURCES} where stage = 'fusion'), r as (select query_id, chunk_id, score as r from {SOURCES} where stage = 'rerank') select query_id, chunk_id, case when coalesce(r, f) >= 0.45 or f >= 0.55 then 'supported' when coalesce(r, f) >= 0.1 then 'weak' else 'unsupported' end as support from f left join r using (query_id, chunk_id)")


@query
def numeric_record_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The greatest record, by its total, of every document that holds records."""
    return history.largest_record(table(spark, d, "documents", "doc_id", "text"), "text", "total", "doc_id")


sql(
    "numeric_record_argmax",
    r"""
with r as (select doc_id, unnest(regexp_extract_all(text, '\d{4}[/-]\d{2}[/-]\d{2}[ \t]+\d+(?:/\d+)?')) as x from documents),
v as (select doc_id, replace(regexp_extract(x, '^(\S+)', 1), '/', '-') as date, regexp_extract(x, '\s(\d+)', 1)::bigint + coalesce(nullif(regexp_extract(x, '/(\d+)$', 1), '')::bigint, 0) as value from r)
select doc_id, date, value from (select *, row_number() over (partition by doc_id order by value desc, date) as k from v) where k = 1
""",
)


@query
def unit_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Values in kilograms that each document states."""
    rows = table(spark, d, "documents", "doc_id", "text")
    return rows.select("doc_id", F.explode(history.unit_values(F.col("text"), "kg")).alias("value"))


sql("unit_mentions", r"with v as (select doc_id, list_distinct(regexp_extract_all(regexp_replace(text, '(\d)\. (\d)', '\1.\2', 'g'), '(?i)(-?\d+(?:\.\d+)?(?:\s*(?:±|\+/-)\s*\d+(?:\.\d+)?)?)\s*kg(?:[^\p{L}\p{N}]|$)', 1)) as l from documents where text is not null) select doc_id, unnest(l) as value from v")

# --- evaluation and observability ------------------------------------------------------------------------------------


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _sources(spark, d)
    gold = _stage(rows, "rerank", "place").where("place <= 5").select("query_id", F.col("chunk_id").alias("id"))
    return _stage(rows, "fusion", "place").select("query_id", F.col("chunk_id").alias("id"), "place"), gold


@query
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The fusion order against the five best of the rerank stage."""
    return evaluation.ranking_metrics(*_judged(spark, d), k=10)


METRICS = f"""
{RERANK}, {FUSION}, g as (select query_id, chunk_id from k where place <= 5), t as (select query_id, count(*) as n from g group by all), w as (select * from fu where place <= 10), wn as (select query_id, count(*) as n from w group by all),
h as (select query_id, count(*) as hits, min(place) as p, sum(1 / log2(place + 1)) as dcg from w join g using (query_id, chunk_id) group by all),
m as (select query_id, coalesce(hits, 0) as hits, round(coalesce(hits, 0) / t.n, 6) as recall_at_k, case when wn.n is null then 0 else round(coalesce(hits, 0) / wn.n, 6) end as precision_at_k, round(coalesce(1 / p, 0), 6) as mrr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(t.n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg_at_k from t left join wn using (query_id) left join h using (query_id))
"""
sql("retrieval_metrics", f"with {METRICS} select * from m")


@query
def grouped_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means of the metrics by size of the query's candidate list and by whether the best was first, in one pass."""
    results, gold = _judged(spark, d)
    sizes = results.groupBy("query_id").agg(F.when(F.count("*") > 15, "long").otherwise("short").alias("length"))
    rows = evaluation.ranking_metrics(results, gold, k=10).join(sizes, "query_id").withColumn("first", F.when(F.col("mrr") == 1, "yes").otherwise("no"))
    rows = rows.withColumn("metrics", F.create_map(F.lit("recall"), F.col("recall_at_k"), F.lit("ndcg"), F.col("ndcg_at_k")))
    return evaluation.metric_means(rows, "length", "first")


sql(
    "grouped_metrics",
    f"""
with {METRICS}, z as (select query_id, case when count(*) > 15 then 'long' else 'short' end as length from fu group by query_id),
x as (select m.*, length, case when mrr = 1 then 'yes' else 'no' end as first from m join z using (query_id)),
y as (select length, first, 'recall' as metric, recall_at_k as v from x union all select length, first, 'ndcg', ndcg_at_k from x)
select 'length' as field, length as "group", metric, round(avg(v), 6) as mean, count(*) as n from y group by length, metric union all select 'first', first, metric, round(avg(v), 6), count(*) from y group by first, metric
""",
)


@query
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Whether each query's sources can carry an answer."""
    rows = _sources(spark, d)
    wide = rows.groupBy("query_id", "chunk_id").agg(F.max("doc_id").alias("doc_id"), *[F.max(F.when(F.col("stage") == s, F.col("score"))).alias(n) for s, n in (("fusion", "score"), ("rerank", "rerank_score"), ("distance", "_d"), ("bm25", "lexical_score"))])
    wide = wide.where("score is not null").withColumn("vector_score", N.distance_score(F.col("_d")))
    out = evaluation.confidence(wide)
    return out.select("query_id", "confidence", "uncertainty", "no_answer", F.array_join("reasons", ",").alias("reasons"))


sql(
    "answer_confidence",
    f"""
with w as (select query_id, chunk_id, max(doc_id) as doc_id, max(case when stage = 'fusion' then score end) as score, max(case when stage = 'rerank' then score end) as rr, 1 / (1 + max(case when stage = 'distance' then score end)) as vs, max(case when stage = 'bm25' then score end) as ls from {SOURCES} group by all having max(case when stage = 'fusion' then score end) is not null),
k as (select *, row_number() over (partition by query_id order by score desc) as n from w),
a as (select query_id, count(*) as c, coalesce(max(rr), max(score)) as rr, max(vs) as vs, max(case when n = 1 then score end) - coalesce(max(case when n = 2 then score end), 0) as gap, count(distinct doc_id) as docs, bool_or(vs is not null and ls is not null) as both_ from k group by all),
f as (select *, round(greatest(0.0::double, least(1.0::double, 0.25::double + least(greatest(rr, 0), 1.5) * 0.22 + case when vs is not null then greatest(0, least(1, vs)) * 0.18 when rr >= 0.1 then 0.08 else 0 end + greatest(0, least(1, gap)) * 0.12 + least(docs, 3) * 0.06 + case when both_ then 0.12 else 0 end)), 4) as confidence from a)
select query_id, confidence, case when confidence < 0.45 then 'high' when confidence < 0.7 then 'medium' else 'low' end as uncertainty, c < 1 or confidence < 0.35 as no_answer,
  concat_ws(',', case when c < 1 then 'too_few_sources' end, case when rr < 0.1 then 'low_rerank_score' end, case when vs < 0.2 and rr < 0.1 then 'low_vector_score' end, case when not both_ and c > 1 and confidence < 0.55 and rr < 0.1 then 'low_vector_bm25_agreement' end, case when confidence < 0.35 then 'low_confidence' end) as reasons from f
""",
)


@query
def staleness(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose embedding model or profile is no longer their document's."""
    docs = table(spark, d, "documents", "doc_id", "embedding_model_id", "chunking_profile").alias("current")
    rows = _chunks(spark, d, "doc_id", "embedding_model_id", "chunking_profile").alias("stored").join(docs, "doc_id")
    reasons = evaluation.stale_reasons("stored", "current", (("chunking_profile", "chunking_config_changed"), ("embedding_model_id", "embedding_model_changed")))
    return rows.select(F.col("stored.id").alias("id"), F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


sql("staleness", f"select * from (select c.id, concat_ws(',', case when c.chunking_profile is distinct from d.chunking_profile then 'chunking_config_changed' end, case when c.embedding_model_id is distinct from d.embedding_model_id then 'embedding_model_changed' end) as reasons from {CHUNKS} c join documents d using (doc_id)) where reasons <> ''")


@query
def index_health(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.index_health(table(spark, d, "documents", "status"), _chunks(spark, d, "text", "char_count", "embedding_model_id"))


sql(
    "index_health",
    f"""
with d as (select count(*) as document_count, count(*) filter (status like 'failed%') as failed_count, count(*) filter (status = 'ready') as ready_count from documents),
c as (select count(*) as chunk_count, count(embedding_model_id) as embedded_count, round(avg(coalesce(char_count, length(text))), 2) as average_length, median(coalesce(char_count, length(text))) as median_length, min(coalesce(char_count, length(text))) as min_length, max(coalesce(char_count, length(text))) as max_length from {CHUNKS}),
u as (select sum(n)::bigint as n, sum(n - 1)::bigint as duplicate_count from (select count(*) as n from {CHUNKS} where text is not null group by text))
select d.*, c.*, duplicate_count, round(duplicate_count / u.n, 6) as duplicate_rate from d, c, u
""",
)


@query
def duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.duplicate_rate(table(spark, d, "documents", "text").where("text is not null"))


sql("duplicate_rate", "select sum(c)::bigint as n, sum(c - 1)::bigint as duplicates, round(sum(c - 1) / sum(c), 6) as duplicate_rate from (select count(*) as c from documents where text is not null group by text)")


@query
def corpus_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.corpus_snapshot(table(spark, d, "documents", "path"))


sql("corpus_snapshot", r"with e as (select lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) as e from documents) select case when e in ('pdf', 'docx', 'xlsx', 'csv') then e when e = 'md' then 'markdown' when e = 'txt' then 'text' when e in ('py', 'js', 'ts', 'html', 'json') then 'code' else 'other' end as kind, count(*) as documents from e group by 1")


@query
def source_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and kind with their subtotals: a roll-up, pre-aggregated before the shuffle."""
    rows = table(spark, d, "documents", "source", "doc_type", "n_chars").withColumns({"source": F.coalesce("source", F.lit("-")), "doc_type": F.coalesce("doc_type", F.lit("-"))})
    of = rows.rollup("source", "doc_type").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))
    return of.select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("doc_type", F.lit("*")).alias("doc_type"), "documents", "chars", F.col("level").cast("int").alias("level"))


sql("source_rollup", "select coalesce(s, '*') as source, coalesce(t, '*') as doc_type, count(*) as documents, sum(n_chars)::bigint as chars, grouping(s, t)::int as level from (select coalesce(source, '-') as s, coalesce(doc_type, '-') as t, n_chars from documents) group by rollup (s, t)")


@query
def job_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events as jobs of a user's run: counts of each state and the run's status."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").otherwise("cancelled")
    return evaluation.run_rollup(table(spark, d, "events", "user_id", "event_type").select(F.col("user_id").alias("run_id"), state.alias("status")))


sql(
    "job_rollup",
    """
with a as (select user_id as run_id, count(*) as total, count(*) filter (event_type = 'view') as queued, count(*) filter (event_type = 'click') as running, count(*) filter (event_type = 'purchase') as succeeded, count(*) filter (event_type = 'error') as failed, count(*) filter (event_type not in ('view', 'click', 'purchase', 'error')) as cancelled from events group by all)
select *, case when queued + running > 0 then 'running' when cancelled = total then 'cancelled' when failed > 0 then 'completed_with_errors' else 'completed' end as status from a
""",
)


@query
def newest_page(spark: SparkSession, d: str) -> DataFrame:
    """The twenty newest events before event 500 as a page of messages."""
    return history.page_before(table(spark, d, "events", "event_id", "user_id", "event_type"), 500, 20, "event_id")


sql("newest_page", "with p as (select event_id, user_id, event_type from events where event_id < 500 order by event_id desc limit 21) select *, (select count(*) > 20 from p) as has_more from (select * from p order by event_id desc limit 20)")


@query
def history_budget(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a document as turns of a conversation: what fits in a share of the context."""
    turns = _chunks(spark, d, "doc_id", "chunk_index", "text").where("text is not null").select(F.col("doc_id").alias("conversation_id"), F.col("chunk_index").alias("turn"), F.when(F.col("chunk_index") % 2 == 0, "user").otherwise("assistant").alias("role"), "text")
    return history.history_budget(turns, 800).select("conversation_id", "turn", "tokens", "pinned")


sql(
    "history_budget",
    f"""
with t as (select doc_id as conversation_id, chunk_index as turn, greatest((length(text) + 3) // 4, 1)::int as tokens, chunk_index % 2 = 0 as u from {CHUNKS} where text is not null),
f as (select *, turn = min(case when u then turn end) over (partition by conversation_id) as pinned from t),
s as (select *, sum(case when pinned then tokens else 0 end) over (partition by conversation_id) as held, sum(case when pinned then 0 else tokens end) over (partition by conversation_id order by turn desc rows between unbounded preceding and current row) as newer from f)
select conversation_id, turn, tokens, pinned from s where coalesce(pinned, false) or held + newer <= 280
""",
)

# --- joins and aggregates of the relational part ---------------------------------------------------------------------


@query
def semi_or_exists(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an open order or a dear one: a disjunction of two semi joins, as one over the union of keys."""
    orders = table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_totalprice")
    keys = orders.where("o_orderstatus = 'O' or o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer", "c_custkey", "c_name").join(keys, "c_custkey", "left_semi")


sql("semi_or_exists", "select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'O') or exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_totalprice > 400000)")


@query
def anti_unused(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no line item orders in quantities above 49."""
    used = table(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part", "p_partkey", "p_name").join(used, "p_partkey", "left_anti")


sql("anti_unused", "select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")


@query
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """A star join: line items to orders, customers and nations, aggregated by nation and year."""
    items = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).join(table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


sql("revenue_by_nation", "select n_name, year(o_orderdate)::int as year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all")


@query
def latest_order(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's latest order: max_by over a struct, no window."""
    rows = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    top = rows.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("t"))
    return top.select("o_custkey", F.col("t.o_orderkey").alias("o_orderkey"), F.col("t.o_totalprice").alias("o_totalprice"))


sql("latest_order", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1")


@query
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Documents by where their text turns up: among chunks' and blocks' documents."""
    a = table(spark, d, "chunks", "doc_id").distinct()
    b = table(spark, d, "document_blocks", "doc_id").distinct()
    return a.intersect(b).withColumn("part", F.lit("both")).union(a.subtract(b).withColumn("part", F.lit("chunks"))).union(b.subtract(a).withColumn("part", F.lit("blocks")))


sql("set_operations", "with a as (select distinct doc_id from chunks), b as (select distinct doc_id from document_blocks) select doc_id, 'both' as part from (from a intersect from b) union all select doc_id, 'chunks' from (from a except from b) union all select doc_id, 'blocks' from (from b except from a)")



# --- pipeline and streams --------------------------------------------------------------------------------------------


@query
def retrieval_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Every held-out question to its context: lexical and dense search, fusion, prior, rerank, window."""
    return pipeline.retrieve(_questions(spark, d), _chunks(spark, d, "doc_id", "text")).drop("subqueries")


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = events.timed(table(spark, d, "events", "ts", "event_type", "value"))
    return events.window_counts(rows).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


WINDOWS = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all"
sql("event_windows", WINDOWS)


@query
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows from a stream with a watermark, run over what is there."""
    rows = events.timed(events.event_stream(spark, d), late="1 hour")
    out = events.run_available(events.window_counts(rows), "windows", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


sql("stream_windows", WINDOWS)


@query
def stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Runs rolled up from a stream of their jobs' states."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").otherwise("cancelled")
    jobs = events.event_stream(spark, d).select(F.col("user_id").alias("run_id"), state.alias("status"))
    return events.run_available(evaluation.run_rollup(jobs), "rollup", "complete")


sql("stream_rollup", SQL["job_rollup"])


@query
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = events.timed(table(spark, d, "events", "ts", "user_id"))
    return events.sessions(rows, "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


sql(
    "user_sessions",
    """
with g as (select user_id, ts, case when ts - lag(ts) over w >= interval 6 hours or lag(ts) over w is null then 1 else 0 end as b from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k
""",
)


@query
def new_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each content, without those whose content a smaller id has: the incremental ingest's rule, as counts by source."""
    rows = table(spark, d, "documents", "doc_id", "text", "source").where("text is not null").withColumn("h", F.sha2("text", 256))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    kept = rows.join(first, ["h", "doc_id"])
    return kept.groupBy(F.coalesce("source", F.lit("-")).alias("source")).agg(F.count("*").alias("documents"))


sql("new_documents", "with k as (select source, row_number() over (partition by text order by doc_id) as n from documents where text is not null) select coalesce(source, '-') as source, count(*) as documents from k where n = 1 group by 1")

# --- laid-out documents ----------------------------------------------------------------------------------------------


@query
def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Parents and children of every document's blocks."""
    rows = table(spark, d, "document_blocks", "block_id", "doc_id", "block_index", "block_type", "text", "heading_path", "page_number", "bounding_box").dropDuplicates(["block_id"])
    return chunking.structured_chunks(rows.drop("block_id")).select("doc_id", "parent_no", "child_no", "text", "block_type", F.array_join("heading_path", " > ").alias("section"), "page", "first_block")


_WORDS = r"greatest(len(regexp_extract_all({0}, '[^ \t\n\x0b\f\r]+')), 1)"
sql(
    "structured_chunks",
    rf"""
with recursive b0 as (select distinct on (doc_id, block_index) doc_id, block_index, regexp_replace(text, '^\s+|\s+$', '', 'g') as text, coalesce(block_type, '') as kind, coalesce(array_to_string(heading_path, chr(1)), '') as path, coalesce(array_to_string(heading_path, ' > '), '') as section, page_number as page, {_WORDS.format("text")} as size
  from (select distinct on (block_id) * from document_blocks order by block_id) where doc_id is not null and regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' and coalesce(block_type, '') not in ('header', 'footer') order by doc_id, block_index),
b1 as materialized (select *, path || chr(2) || coalesce(page::varchar, '') || chr(2) || kind as key, kind = 'table' or size > 150 as alone, kind in ('title', 'heading') as head, row_number() over (partition by doc_id order by block_index) as i from b0),
fo as (select doc_id, 0::bigint as i, 0 as p, 0::bigint as n, ''::varchar as path, false as has, -1 as c, 0::bigint as m, ''::varchar as key, false as open_, 0 as op, -1 as oc from b1 where i = 1
  union all select doc_id, i, p2 + full_::int, case when full_ then 0 else n2 end, case when full_ then '' else path2 end, not full_, c2, case when head then m else m2 end, case when head then key else bkey end, open2 and not full_, p2, case when head then -1 else c2 end
  from (select *, case when head then open_ and not closes else not alone and m2 < 110 and kind not in ('caption', 'footnote') end as open2, case when head or goes then c else c + 1 end as c2
    from (select *, n2 >= 520 and not head as full_, p + closes::int as p2, case when bpath <> '' then bpath when closes then '' else path end as path2, case when goes then m else 0 end + size as m2
      from (select *, case when closes then size else n + size end as n2, open_ and not closes and not alone and key = bkey and m + size <= 150 as goes
        from (select fo.doc_id, b1.i, fo.p, fo.n, fo.path, fo.c, fo.m, fo.key, fo.open_, b1.size, b1.head, b1.alone, b1.kind, b1.key as bkey, b1.path as bpath, fo.has and (fo.n + b1.size > 650 or (b1.path <> '' and fo.path <> '' and b1.path <> fo.path and fo.n >= 173)) as closes
          from fo join b1 on b1.doc_id = fo.doc_id and b1.i = fo.i + 1))))),
ch as materialized (select doc_id, op as p, oc as c, string_agg(text, chr(10) order by i) as text, arg_min(kind, i) as kind, arg_min(section, i) as section, min(page) as page, min(block_index) as first_block, bool_or(alone) as alone from fo join b1 using (doc_id, i) where oc >= 0 group by all),
tl as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l, {_WORDS.format("text")} as w from ch),
tr as (select doc_id, c, l[1] as h, {_WORDS.format("l[1]")} as hn, l[k] as line, {_WORDS.format("l[k]")} as n, k - 1 as i from tl, unnest(range(2, len(l) + 1)) t(k) where kind = 'table' and w > 150 and len(l) >= 2),
tf as (select doc_id, c, 1::bigint as i, 0 as part, hn + n as n from tr where i = 1 union all select tr.doc_id, tr.c, tr.i, part + (tf.n + tr.n > 150)::int, case when tf.n + tr.n > 150 then tr.hn else tf.n end + tr.n from tf join tr on tr.doc_id = tf.doc_id and tr.c = tf.c and tr.i = tf.i + 1),
tp as (select doc_id, c, part as k, any_value(h) || chr(10) || string_agg(line, chr(10) order by i) as piece from tf join tr using (doc_id, c, i) group by all),
bl as (select doc_id, c, bi, l[bi] as block from (select doc_id, c, {BLOCKS} as l from ch where alone and kind <> 'table'), unnest(range(1, len(l) + 1)) t(bi)),
ln as (select *, list_filter(list_transform(string_split(block, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from bl),
us as (select doc_id, c, bi, case when len(ls) > 1 and len(list_filter(ls, lambda x: regexp_matches(x, '\d') and (regexp_matches(x, '[,\t/]') or regexp_matches(x, '\s\d')))) >= greatest(2, len(ls) // 2) then ls else {SENTENCES.format("block")} end as us from ln),
pc as (select doc_id, c, array_to_string(w[s + 1:s + 150], ' ') as u, least(150, len(w) - s) as n, row_number() over (partition by doc_id, c order by bi, ui, s) as i from (select doc_id, c, bi, ui, regexp_split_to_array(us[ui], '\s+') as w from us, unnest(range(1, len(us) + 1)) t(ui)), unnest(range(0, len(w), 150)) t(s)),
pk as (select doc_id, c, 1::bigint as i, 0 as k, n from pc where i = 1 union all select pc.doc_id, pc.c, pc.i, k + (pk.n >= 110 or pk.n + pc.n > 150)::int, case when pk.n >= 110 or pk.n + pc.n > 150 then pc.n else pk.n + pc.n end from pk join pc on pc.doc_id = pk.doc_id and pc.c = pk.c and pc.i = pk.i + 1),
pp as (select doc_id, c, k, string_agg(u, ' ' order by i) as piece from pk join pc using (doc_id, c, i) group by all),
al as (select doc_id, c, k, piece from tp union all select doc_id, c, k, piece from pp union all select doc_id, c, 0, text from tl where not alone or (kind = 'table' and (w <= 150 or len(l) < 2)))
select doc_id, p as parent_no, (row_number() over (partition by doc_id order by c, k) - 1)::int as child_no, piece as text, kind as block_type, section, page, first_block from al join ch using (doc_id, c)
""",
)


@query
def parent_summaries(spark: SparkSession, d: str) -> DataFrame:
    """An extractive summary of every document's parents."""
    rows = table(spark, d, "documents", "doc_id", "text")
    parents = rows.select("doc_id", F.posexplode(T.parent_chunks(F.col("text"))).alias("parent_no", "text"))
    return parents.select("doc_id", "parent_no", chunking.summary(F.col("text")).alias("summary"))


@query
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    """The open headings above every block, by running windows."""
    rows = table(spark, d, "document_blocks", "block_id", "doc_id", "block_index", "block_type", "text", "heading_level").dropDuplicates(["block_id"]).withColumnRenamed("heading_level", "level")
    return layout.heading_paths(rows).select("block_id", F.array_join("heading_path", " > ").alias("section"))


sql(
    "heading_paths",
    """
with b as (select distinct on (block_id) * from document_blocks order by block_id), h as (select *, case when block_type = 'title' then 0 when block_type = 'heading' then least(coalesce(heading_level, 1), 4) end as l from b),
w as (select block_id, """
    + ", ".join(f"max(case when l = {n} then {{'i': block_index, 't': text}} end) over (partition by doc_id order by block_index rows between unbounded preceding and current row) as h{n}" for n in range(5))
    + " from h) select block_id, concat_ws(' > ', "
    + ", ".join(f"case when h{n}.i > greatest(-1, {', '.join([f'coalesce(h{m}.i, -1)' for m in range(n)] or ['-1'])}) then h{n}.t end" for n in range(5))
    + ") as section from w",
)


@query
def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The union of the boxes of each page's blocks."""
    rows = table(spark, d, "document_blocks", "block_id", "doc_id", "page_number", "bounding_box").dropDuplicates(["block_id"]).where("bounding_box is not null and page_number is not null")
    b = [F.col("bounding_box")[i] for i in range(4)]
    return rows.groupBy("doc_id", "page_number").agg(F.min(b[0]).alias("x0"), F.min(b[1]).alias("top"), F.max(b[2]).alias("x1"), F.max(b[3]).alias("bottom"))


sql("page_boxes", "select doc_id, page_number, min(bounding_box[1]) as x0, min(bounding_box[2]) as top, max(bounding_box[3]) as x1, max(bounding_box[4]) as bottom from (select distinct on (block_id) * from document_blocks order by block_id) where bounding_box is not null and page_number is not null group by all")


@query
def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_blocks", "block_id", "doc_id", "font_size", "text").dropDuplicates(["block_id"]).where("font_size is not null and text is not null")
    return layout.body_size(rows.withColumnRenamed("font_size", "size"))


sql("body_sizes", "with s as (select doc_id, round(font_size, 1) as s, sum(length(text)) as n from (select distinct on (block_id) * from document_blocks order by block_id) where font_size is not null and text is not null group by all) select doc_id, s as body_size from (select *, row_number() over (partition by doc_id order by n desc, s) as k from s) where k = 1")

# --- around retrieval ------------------------------------------------------------------------------------------------


@query
def retrieval_routes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_cases", "item_id", "question").where("question is not null")
    return rows.select("item_id", catalogue.retrieval_route(F.col("question"), F.lit("auto")).alias("route"))


sql(
    "retrieval_routes",
    "with c as (select item_id, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) as p from eval_cases where question is not null) select item_id, case when "
    + " or ".join(f"contains(p, '{x}')" for x in catalogue.DOCUMENT_CUES)
    + f" then 'medium' when regexp_matches(p, '{catalogue.GREETING}') or "
    + " or ".join(f"contains(p, '{x}')" for x in catalogue.OTHER_CUES)
    + " or (len(string_split(p, ' ')) <= 4 and not p like '%?') then 'off' else 'medium' end as route from c",
)


@query
def document_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Every document's name, its number of chunks and the ids of its preview."""
    made = catalogue.document_payloads(table(spark, d, "documents", "doc_id", "display_name", "path"), _chunks(spark, d, "doc_id", "chunk_index", "text"))
    return made.select("doc_id", "name", "n_chunks", F.coalesce(F.array_join(F.transform("preview", lambda p: p["id"]), ","), F.lit("")).alias("preview_ids"))


sql(
    "document_payloads",
    f"""
with p as (select doc_id, count(*) as n, string_agg(id, ',' order by chunk_index, id) filter (k <= 20) as ids from (select *, row_number() over (partition by doc_id order by chunk_index, id) as k from {CHUNKS}) group by doc_id)
select doc_id, coalesce(nullif(trim(display_name), ''), list_last(string_split(path, '/'))) as name, coalesce(n, 0) as n_chunks, coalesce(ids, '') as preview_ids from documents left join p using (doc_id)
""",
)


@query
def retrieval_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.retrieval_counts(table(spark, d, "documents", "doc_id"), table(spark, d, "compression_sources", "query_id", "doc_id"))


sql("retrieval_counts", "select doc_id, count(distinct query_id) as retrieval_count from documents left join compression_sources using (doc_id) group by doc_id")


@query
def unit_answers(spark: SparkSession, d: str) -> DataFrame:
    """What each query's fusion results say in kilograms, rendered with citations."""
    rows = _stage(_sources(spark, d), "fusion", "place").join(_chunks(spark, d, "text").withColumnRenamed("id", "chunk_id"), "chunk_id")
    found = rows.select("query_id", "place", F.concat(F.lit("S"), F.col("place").cast("string")).alias("source_id"), F.explode(history.unit_values(F.col("text"), "kg")).alias("value"))
    return catalogue.unit_answers(found)


sql(
    "unit_answers",
    rf"""
with {FUSION}, v0 as (select query_id, place, list_distinct(regexp_extract_all(regexp_replace(c.text, '(\d)\. (\d)', '\1.\2', 'g'), '(?i)(-?\d+(?:\.\d+)?(?:\s*(?:±|\+/-)\s*\d+(?:\.\d+)?)?)\s*kg(?:[^\p{{L}}\p{{N}}]|$)', 1)) as l from fu join {CHUNKS} c on c.id = fu.chunk_id where c.text is not null),
v1 as (select query_id, min(place) as place, value from (select query_id, place, unnest(l) as value from v0) group by query_id, value),
v2 as (select *, row_number() over (partition by query_id order by place, value) as k from v1),
v3 as (select query_id, count(*) as n, string_agg('**' || value || '** [[src:S' || place || ']]', chr(10) || '- ' order by k) as items from v2 where k <= {catalogue.MOST_VALUES} group by query_id)
select query_id, case when n = 1 then 'The document states ' || items || '.' else 'The document states several values in that unit:' || chr(10) || '- ' || items || chr(10) || 'Which is meant the question doesn''t say.' end as answer from v3
""",
)


@query
def quality_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Each held-out passage judged as an answer to its question, with itself as the context."""
    rows = table(spark, d, "eval_cases", "item_id", "question", "passage").where("question is not null and passage is not null")
    made = evaluation.quality_estimates(F.col("question"), F.col("passage"), F.col("passage"))
    return rows.select("item_id", made.alias("q")).select("item_id", "q.*")


_LAPS = "case when len({0}) = 0 or len({1}) = 0 then 0 else len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) end"
sql(
    "quality_estimates",
    f"""
with e as (select item_id, {_words_sql("question")} as q, {_words_sql("passage")} as p, {SENTENCES.format("passage")} as ss from eval_cases where question is not null and passage is not null),
s as (select e.*, {_words_sql("ss[i]")} as w, i from e, unnest(range(1, len(ss) + 1)) t(i)),
n as (select item_id, count(*) as n, count(*) filter ({_LAPS.format("w", "q")} > 0) as r, count(*) filter ({_LAPS.format("w", "p")} >= 0.35) as g from s group by item_id)
select item_id, coalesce(round(r / n, 6), 0) as context_relevance, coalesce(round(g / n, 6), 0) as groundedness, round({_LAPS.format("p", "q")}, 6) as answer_relevance from e left join n using (item_id)
""",
)


_CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"
QUALIFIES = (
    rf"(len(regexp_extract_all({_CLEAN}, '[\p{{{{L}}}}\p{{{{N}}}}_%.-]+')) >= {named.LEAST_WORDS} and not regexp_matches({_CLEAN}, '{named.REFERENCE_ONLY}') and regexp_matches({_CLEAN}, '[A-Za-z]{{{{3}}}}')"
    + rf" and not (len(regexp_extract_all({_CLEAN}, '{named.CITING.replace('{2}', '{{2}}')}')) >= 3 and not regexp_matches({_CLEAN}, '{named.SUBJECT}')) and regexp_matches({_CLEAN}, '{named.MARKER}'))"
)


@query
def chunk_classes(spark: SparkSession, d: str) -> DataFrame:
    """Which chunks would be expanded by layout, and which can be evidence."""
    rows = _chunks(spark, d, "text", "block_type").where("text is not null")
    return rows.select("id", selection.wants_layout(F.lit(""), F.col("text"), F.coalesce("block_type", F.lit("paragraph"))).alias("expands"), named.qualifies(F.col("text")).alias("qualifies"))


sql(
    "chunk_classes",
    rf"""
select id, coalesce(block_type, 'paragraph') in ('table', 'caption', 'footnote') or regexp_matches(ltrim(text, ' '), '(?i)^(?:this|that|these|those|it|they|such|the (?:above|following|latter|former))(?:[^\p{{L}}\p{{N}}_]|$)') as expands,
  {QUALIFIES.format("text")} as qualifies
from {CHUNKS} where text is not null
""",
)
