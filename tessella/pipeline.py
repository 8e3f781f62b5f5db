"""Questions to cited context, as one plan over batches: search, fuse, rerank, select, assemble."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import char_tokens, subqueries
from tessella.operators import named, retrieval
from tessella.providers import Embedder, HashEmbedder, OverlapReranker, Reranker
from tessella.session import materialise


@dataclass(frozen=True)
class Settings:
    depth: int = 20
    window: int = 8
    lexical: bool = True
    dense: bool = True
    rerank: bool = True
    scope: str = "normal"

    def __post_init__(self) -> None:
        if not (self.lexical or self.dense) or self.depth < 1 or self.window < 1:
            raise ValueError("one search at least, and depth and window of 1 at least")


def retrieve(questions: DataFrame, chunks: DataFrame, settings: Settings = Settings(), embedder: Embedder | None = None, reranker: Reranker | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """query_id, place, id, doc_id, score, fusion_score, dense_rank, lexical_rank, subqueries of each question's context.

    questions has query_id, text; chunks id, doc_id, text; summaries, if any, parent_id, text, and chunks a parent_id
    then. A question of several parts is searched as a whole and by part: all of them are rows of one search, whose
    hits merge by question before they are reranked against the whole. The dense search's first is always in the window.
    """
    embedder, reranker = embedder or HashEmbedder(), reranker or OverlapReranker()
    depth, window = retrieval.scope_settings(settings.scope, settings.depth, settings.window)
    texts = chunks.where("text is not null").select("id", "doc_id", "text")
    prompts = questions.where("text is not null").select(F.col("query_id").alias("_q"), F.col("text").alias("prompt"))
    asked = prompts.select("_q", F.explode(subqueries(F.col("prompt"))).alias("s")).select(F.struct("_q", F.col("s.id").alias("part")).alias("_of"), "s.text")
    # a search's query_id names the question and the part; the name is given back when hits merge
    asked = asked.select(F.concat_ws("\x01", F.col("_of._q").cast("string"), "_of.part").alias("query_id"), "text", "_of")
    none = asked.limit(0)
    if settings.lexical:
        lexical = retrieval.bm25(asked, texts, most=depth)
    else:
        lexical = none.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("lexical_score"), F.lit(0).alias("lexical_rank"))
    near_summaries, parents = None, None
    if settings.dense:
        vectors = texts.select("id", embedder.embed(F.col("text")).alias("vector"))
        queries = asked.select("query_id", embedder.embed(F.col("text")).alias("vector"))
        dense = retrieval.dense(queries, vectors, key="id", most=depth)
        if summaries is not None:
            known = summaries.where("text is not null").select(F.col("parent_id").alias("vec_id"), "parent_id", embedder.embed(F.col("text")).alias("vector"), F.lit("summary").alias("source_kind"))
            near_summaries, parents = retrieval.summary_hits(queries, known, depth), chunks.select("id", "parent_id")
    else:
        dense = none.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("vector_score"), F.lit(0).alias("dense_rank"))
    fused = retrieval.fuse(dense, lexical, most=depth, parents=parents, summaries=near_summaries)
    found = fused.join(asked.select("query_id", "_of"), "query_id").select(F.col("_of._q").alias("query_id"), "id", F.col("fusion_score").alias("score"), "dense_rank", "lexical_rank", F.col("_of.part").alias("subquery_id"))
    merged = retrieval.merge_candidates(found).withColumnRenamed("score", "fusion_score")
    hits = merged.join(prompts.withColumnRenamed("_q", "query_id"), "query_id").join(texts, "id")
    prior = retrieval.prior_score(F.col("prompt"), F.col("text"), F.col("lexical_rank"), F.col("dense_rank"))
    raw = reranker.score(F.col("prompt"), F.col("text")) if settings.rerank else F.lit(None).cast("double")
    scored = hits.select("query_id", "id", "doc_id", retrieval.blended(raw, prior).alias("score"), "fusion_score", "dense_rank", "lexical_rank", F.col("subquery_ids").alias("subqueries"))
    return retrieval.anchored_window(scored, window).select("query_id", F.col("window_rank").alias("place"), "id", "doc_id", "score", "fusion_score", "dense_rank", "lexical_rank", "subqueries")


# The bounds of the second round, and the words that its query adds.
GAP_SOURCES, GAP_DEPTH, GAP_SHARE, GAP_LEAST = 3, 12, 0.50, 128
HINTS = ("results", "measured", "evidence", "values", "units", "limitations")


def gap_query(titles: Column, needs: Column, texts: Column) -> Column:
    """The second question: up to three titles in quotes, four needs, 18 terms of the requirements, and words of evidence that aren't among them."""
    words = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))))
    terms = F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(*named.STOPWORDS)))
    quoted = F.transform(F.slice(F.array_distinct(titles), 1, 3), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    wanted = F.array_distinct(needs)
    hints = F.array_except(F.array(*[F.lit(h) for h in HINTS]), F.concat(terms, wanted))
    return F.array_join(F.concat(quoted, F.slice(wanted, 1, 4), F.slice(terms, 1, 18), hints), " ")


def gap_round(questions: DataFrame, context: DataFrame, ledger: DataFrame, chunks: DataFrame, most: int = GAP_SOURCES, parent_most: int = 650) -> DataFrame:
    """query_id, place, id, tokens: for questions with requirements not met, up to most more chunks, none of which is there yet.

    One more question is made of what lacks evidence (gap_query). ledger has query_id, requirement_id, status, text, and
    may have title and needs (named.needs) of requirements that name a document; context query_id, id, and may have
    chunk_ids, what a unit was widened to. What is added costs half of the context's tokens at most (128 at least,
    parent_most at most); a chunk that doesn't fit is passed over. For a named gap only its document's passages count.
    """
    text = chunks.where("text is not null").dropDuplicates(["id"]).select("id", "text", char_tokens(F.col("text")).alias("tokens"))
    title = F.col("title") if "title" in ledger.columns else F.lit(None).cast("string")
    wants = F.col("needs") if "needs" in ledger.columns else F.lit(None).cast("array<string>")
    gaps = ledger.where("status <> 'sufficient'").select("query_id", "requirement_id", "text", title.alias("title"), wants.alias("needs"))
    listed = gaps.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("requirement_id", "text", "title", "needs"))).alias("g"))
    none = F.array().cast("array<string>")
    wanting = listed.select("query_id", gap_query(F.filter(F.transform("g", lambda x: x["title"]), lambda t: t.isNotNull()), F.flatten(F.transform("g", lambda x: F.coalesce(x["needs"], none))), F.transform("g", lambda x: F.coalesce(x["text"], F.lit("")))).alias("text"))
    # a search reads its questions several times, and its hits are read by every join: both are a few rows a question
    more = materialise(retrieval.bm25(materialise(wanting, "gap-questions"), text, most=GAP_DEPTH), "gap-hits")
    held = context.select("query_id", "id").union(context.select("query_id", F.explode("chunk_ids").alias("id"))) if "chunk_ids" in context.columns else context.select("query_id", "id")
    fresh = retrieval.unused(more, held.distinct()).join(text, "id")
    if "title" in ledger.columns and {"display_name", "path"} <= set(chunks.columns):
        names = chunks.select("id", F.array("display_name", "path").alias("names")).dropDuplicates(["id"])
        named_gaps = gaps.where("title is not null").select("query_id", F.col("title").alias("_t"))
        fresh = fresh.join(names, "id")
        right = fresh.join(named_gaps, "query_id").where(named.is_document(F.col("_t"), F.col("names")) & named.qualifies(F.col("text"))).select("query_id", "id").distinct()
        free = fresh.join(named_gaps.select("query_id").distinct(), "query_id", "left_anti")
        fresh = free.unionByName(fresh.join(right, ["query_id", "id"], "left_semi"))
    spent = held.distinct().join(text, "id").groupBy("query_id").agg(F.sum("tokens").alias("n"))
    budget = F.least(F.lit(parent_most), F.greatest(F.lit(GAP_LEAST), F.floor(F.coalesce("n", F.lit(0)) * GAP_SHARE))).cast("int")
    ordered = fresh.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("lexical_score")).alias("s"), "id", "tokens"))).alias("c")).join(spent, "query_id", "left").withColumn("left", budget)
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<id:string,tokens:int>>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        fits = (x["tokens"] <= a["left"]) & (F.size(a["out"]) < most)
        return F.struct((a["left"] - F.when(fits, x["tokens"]).otherwise(0)).cast("int").alias("left"), F.when(fits, F.array_append(a["out"], F.struct(x["id"].cast("string").alias("id"), x["tokens"].alias("tokens")))).otherwise(a["out"]).alias("out"))

    done = ordered.select("query_id", F.posexplode(F.aggregate("c", start, add, lambda a: a["out"])).alias("place", "o"))
    return done.select("query_id", (F.col("place") + 1).alias("place"), F.col("o.id").alias("id"), F.col("o.tokens").alias("tokens"))
