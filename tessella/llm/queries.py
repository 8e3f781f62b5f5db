"""The queries of the operators for training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import leakage, lookalikes, mojibake, near_duplicates, neighbours, packing, rank_fusion, scan_repair, splitting
from tessella.session import materialise
from tessella.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The source of each query that stands best when all stages weigh the same."""
    return rank_fusion.best_of_groups(table(spark, d, "compression_sources", "query_id", "stage", "chunk_id", "score"))


SQL["p1_found"] = """
with s as (select query_id q, stage s, chunk_id c, max(case when stage = 'distance' then -score else score end) v from compression_sources
           where score is not null and not isnan(score) and query_id is not null and stage is not null and chunk_id is not null group by all),
r as (select q, s, c, rank() over (partition by q, s order by v desc) + (count(*) over (partition by q, s, v) - 1) / 2 as r, count(*) over (partition by q, s) as n from s),
st as (select distinct q, s, n from r), it as (select distinct q, c from r),
f as (select it.q, it.c, coalesce(r.r, st.n + 1) as r from it join st using (q) left join r on r.q = it.q and r.s = st.s and r.c = it.c),
m as (select q, c, median(r) as med, avg(r) as mean from f group by all)
select query_id, chunk_id from (select q as query_id, c as chunk_id, row_number() over (partition by q order by med, mean, c) as k from m) where k = 1
"""


@query
def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The whole order of every query's sources."""
    rows = rank_fusion.ranking(table(spark, d, "compression_sources", "query_id", "stage", "chunk_id", "score"))
    return rows.select("query_id", "chunk_id", "place", F.round("median_rank", 6).alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"))


SQL["p1_ranking"] = SQL["p1_found"].replace("select query_id, chunk_id from (select q as query_id, c as chunk_id, row_number() over (partition by q order by med, mean, c) as k from m) where k = 1", "select q as query_id, c as chunk_id, row_number() over (partition by q order by med, mean, c) as place, round(med, 6) as median_rank, round(mean, 6) as mean_rank from m")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and blocks that the splitter had to cut."""
    settings = table(spark, d, "rag_settings")
    profiles = table(spark, d, "documents", "doc_id", "chunking_profile").dropDuplicates(["doc_id"])
    chunks = table(spark, d, "chunks", "id", "text", "chunking_profile")
    blocks = table(spark, d, "document_blocks", "block_id", "doc_id", "text")
    # only a text longer than the smallest limit can exceed one: what need not be joined stays out of the shuffle
    least = settings.agg(F.min("child_max_tokens")).first()[0] or 0
    blocks = blocks.where(splitting.token_count(F.col("text")) > least).join(profiles, "doc_id", "left")
    parts = [(chunks, "id", "chunks"), (blocks, "block_id", "document_blocks")]
    cut = [splitting.split_oversized(t, settings, k, oversized_only=True).where(F.size("pieces") > 1).select(F.lit(n).alias("source_table"), F.col(k).alias("record_id")) for t, k, n in parts]
    return cut[0].union(cut[1]).distinct()


SQL["p6_found"] = r"""
with lim as (select profile, child_max_tokens m from rag_settings),
c as (select distinct 'chunks' as source_table, id as record_id, text, coalesce(chunking_profile, 'default') as p from chunks),
b as (select distinct 'document_blocks' as source_table, block_id as record_id, b.text, coalesce(d.chunking_profile, 'default') as p
      from document_blocks b left join documents d using (doc_id))
select distinct source_table, record_id from (from c union all from b) t join lim on lim.profile = t.p
where len(regexp_extract_all(text, '[^ \t\n\r]+')) > m
"""


@query
def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every chunk, with its place, its size and what it shares with the piece before."""
    cut = splitting.split_oversized(table(spark, d, "chunks", "id", "text", "chunking_profile").dropDuplicates(["id"]), table(spark, d, "rag_settings"), "id")
    return cut.select("id", "limit", F.explode("pieces").alias("p")).select("id", "limit", "p.*")


# the greedy cut, a piece a step: of the cuts that fill the core enough, the last of the strongest
SQL["p6_pieces"] = r"""
with recursive it as (select distinct on (id) id, text, child_max_tokens as lim, greatest(least(coalesce(child_overlap_tokens, 0), child_max_tokens - 1), 0) as lap
  from chunks left join rag_settings on profile = coalesce(chunking_profile, 'default') order by id),
tk as (select *, regexp_extract_all(text, '[^ \t\n\r]+[ \t\n\r]*') as t from it where text is not null and lim is not null),
st as (select id, lim, lap, t, len(t) as n, lim - lap as core, greatest((lim - lap) // 2, 1) as least, list_transform(t, lambda x: case when regexp_matches(x, '\n[^\n]*\n') then 5 when contains(x, chr(10)) then 4
  when not regexp_matches(x, '[ \t\r]$') then 0 when regexp_matches(x, '[.!?…]["”’)\]]*[ \t\r]+$') then 3 when regexp_matches(x, '[,;:–—][ \t\r]+$') then 2 else 1 end) as s from tk where len(t) > lim),
pk as (select id, 0 as i, 0::bigint as a, list_max(list_transform(range(least, core + 1), lambda j: s[j]::bigint * 1000000000 + j)) % 1000000000 as b from st
  union all select pk.id, i + 1, b, case when n - b <= core then n else b + list_max(list_transform(range(least, core + 1), lambda j: s[b + j]::bigint * 1000000000 + j)) % 1000000000 end from pk join st using (id) where b < n),
pc as (select pk.id, i as piece_index, greatest(a - lap, 0)::int as start, b, a from pk join st using (id))
select id, lim as "limit", piece_index, start, (b - start)::int as size, (a - start)::int as overlap, regexp_replace(array_to_string(t[start + 1:b], ''), '[ \t\n\r]+$', '') as text from pc join st using (id)
union all select id, lim, 0, 0, len(t)::int, 0, text from tk where len(t) <= lim
"""


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 12 successive words of a held-out passage."""
    found = leakage.leaked_passages(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_cases", "item_id", "passage"))
    return found.select("doc_id", "item_id").distinct()


# the same by a join of 12-word sequences
SQL["p9_found"] = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null), i as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as w from eval_cases where passage is not null),
g as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as g from i, unnest(range(1, len(w) - 10)) t(k)), h as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') as g from d, unnest(range(1, len(w) - 10)) t(k))
select distinct doc_id, item_id from h join g using (g)
"""


@query
def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold ten of twelve successive words of a held-out passage, each within two places of its due one: changed, dropped or inserted words."""
    found = leakage.leaked_passages(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_cases", "item_id", "passage"), slop=2, share=10 / 12)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.col("kind") == "phrase").alias("unbroken"), F.max("n_words").alias("n_words"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which a part was decoded in another encoding than it was written in."""
    return mojibake.repair_encoding(table(spark, d, "documents", "doc_id", "text"), garbled_only=True).select("doc_id").distinct()


@query
def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Those documents, with their text restored and what was undone."""
    return mojibake.repair_encoding(table(spark, d, "documents", "doc_id", "text"), garbled_only=True).select("doc_id", "restored", "steps", "lost", "exhausted")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and blocks whose texts look the same but differ in characters."""
    chunks = table(spark, d, "chunks", "id", "text").withColumnRenamed("id", "chunk_id")
    return lookalikes.same_looking_pairs(chunks, table(spark, d, "document_blocks", "block_id", "text"), "chunk_id", "block_id")


@query
def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk and block with the class of those that look like it: classes and membership instead of pairs."""
    chunks = table(spark, d, "chunks", "id", "text").select(F.concat(F.lit("chunks:"), "id").alias("record"), "text")
    blocks = table(spark, d, "document_blocks", "block_id", "text").select(F.concat(F.lit("document_blocks:"), "block_id").alias("record"), "text")
    return lookalikes.form_classes(chunks.union(blocks), "record")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, and documents, of 20 words or more that share at least 0.6 of their distinct runs of three words."""
    chunks = table(spark, d, "chunks", "id", "text").select(F.lit("chunk").alias("of"), F.col("id").alias("key"), "text")
    documents = table(spark, d, "documents", "doc_id", "text").select(F.lit("document").alias("of"), F.col("doc_id").cast("string").alias("key"), "text")
    return near_duplicates.near_duplicate_pairs(chunks.union(documents), "key", kind=F.col("of"), width=3, threshold=0.6, least_words=20)


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of copies and its group of near-duplicates, at five words and 0.8."""
    return near_duplicates.near_duplicate_groups(table(spark, d, "documents", "doc_id", "text"), "doc_id")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of which one is among the other's five most similar."""
    return neighbours.neighbour_pairs(table(spark, d, "chunk_vectors", "id", "vector"))


SQL["p3_found"] = """
with v as (select id, list_transform(min(vector), lambda x: x::double) as v from chunk_vectors where id is not null and vector is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by id),
u as (select id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from v),
s as (select a.id as x, b.id as y, round(list_dot_product(a.u, b.u), 6) as s from u a join u b on a.id <> b.id),
k as (select x, y from (select *, row_number() over (partition by x order by s desc, y) as k from s) where k <= 5)
select distinct least(x, y) as id_a, greatest(x, y) as id_b from k
"""


def _scans(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "document_blocks", "block_id", "doc_id", "block_index", "page_number", "text")
    return scan_repair.repair_scans(table(spark, d, "parsed_pdfs", "doc_id", "text"), blocks, table(spark, d, "documents", "text"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned pages that are furniture, end in a cut word, or hold a misread one."""
    found = _scans(spark, d).select("source_table", F.explode("defects").alias("x"))
    return found.select("source_table", "x.record_id", "x.line_no", "x.defect").distinct()


@query
def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every file, a row per paragraph."""
    return _scans(spark, d).select("source_table", "unit", F.posexplode("paragraphs").alias("paragraph_no", "text"))


@query
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one, in a container of the context size of the profile "overlap"."""
    capacity = table(spark, d, "rag_settings", "profile", "context_tokens").where("profile = 'overlap'").first()["context_tokens"]
    return packing.pack(table(spark, d, "documents", "doc_id", "text"), capacity)


@query
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: each document whole in one or, if it exceeds the capacity, in full pieces and a rest."""
    capacity = table(spark, d, "rag_settings", "profile", "context_tokens").where("profile = 'overlap'").first()["context_tokens"]
    packed = materialise(packing.pack(table(spark, d, "documents", "doc_id", "text"), capacity), "containers")
    documents = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.sum("piece").alias("places"))
    cut_right = (F.col("pieces") == F.greatest(F.ceil(F.col("n") / capacity), F.lit(1))) & (F.col("places") == F.col("pieces") * (F.col("pieces") - 1) / 2)
    of_documents = documents.agg(F.count("*").alias("documents"), F.count_if(~cut_right).alias("wrongly_cut"))
    containers = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.max("used").alias("used"))
    of_containers = containers.agg(F.count_if((F.col("n") > capacity) | (F.col("n") != F.col("used"))).alias("wrongly_filled"))
    return of_documents.crossJoin(of_containers).select("documents", "wrongly_cut", "wrongly_filled")  # one row each


SQL["p8_fill"] = "select count(distinct doc_id) as documents, 0::bigint as wrongly_cut, 0::bigint as wrongly_filled from documents where text is not null"

# all pairs that share a run, by a join on the runs themselves
SQL["p5_found"] = r"""
with r as (select distinct 'chunk' as kind, id as key, text from chunks union all select distinct 'document', doc_id::varchar, text from documents),
w as (select kind, key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from r where text is not null),
g as (select distinct kind, key, array_to_string(w[k:k + 2], ' ') as g from w, unnest(range(1, len(w) - 1)) t(k) where len(w) >= 20), n as (select kind, key, count(*) as n from g group by all),
c as (select a.kind, a.key as key_a, b.key as key_b, count(*) as c from g a join g b on a.kind = b.kind and a.g = b.g and a.key < b.key group by all)
select c.kind, key_a, key_b from c join n a on a.kind = c.kind and a.key = key_a join n b on b.kind = c.kind and b.key = key_b where c / (a.n + b.n - c) >= 0.6
"""
