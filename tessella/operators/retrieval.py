"""Retrieval over batches of queries: lexical and dense search, fusion, merging, priors, selection windows.

Every operator takes and gives DataFrames keyed by query_id, so one plan answers one question or thousands. Ranks are
row numbers under a total order; scores are rounded to 6 decimals before they rank, so that equal texts stay equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.numbers import distance_score
from tessella.functions.text import QUERY_STOPWORDS, WORDS, search_terms, words_of
from tessella.session import materialise

RRF_K = 60
#: Term lists of queries up to this many rows are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast, given only where the size has been counted."""
    return F.broadcast(df) if len(df.limit(most + 1).select(F.lit(1)).take(most + 1)) <= most else df


def ranked(df: DataFrame, score: str, ties: list[str], rank: str, most: int | None = None, by: str = "query_id") -> DataFrame:
    """df with the place of each row in its query, best score first; with most, only that many places."""
    at = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    out = df.withColumn(rank, F.row_number().over(at))
    return out if most is None else out.where(F.col(rank) <= most)


def query_terms(queries: DataFrame, text: str = "text", most: int = 24) -> DataFrame:
    return queries.select("query_id", F.explode(search_terms(F.col(text), most)).alias("term"))


def bm25(queries: DataFrame, chunks: DataFrame, key: str = "id", text: str = "text", most: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, key, lexical_score, lexical_rank: the chunks of each query's best BM25 scores over its terms.

    A term matches words that begin with it. idf is ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Only postings of
    terms that some query has are made: words meet the queries' terms before anything is shuffled.
    """
    terms = query_terms(queries)
    asked = terms.select("term").distinct()
    docs = chunks.select(F.col(key).alias("_k"), words_of(F.col(text)).alias("_w"))
    stats = docs.agg(F.count("*").alias("_n"), F.avg(F.size("_w")).alias("_avg"))
    words = docs.select("_k", F.size("_w").alias("_dl"), F.explode("_w").alias("_word"))
    # a term matches prefixes of its own length: an equi-join of words' prefixes with the terms, not a scan of pairs
    lengths = [r[0] for r in asked.select(F.char_length("term").alias("n")).distinct().orderBy("n").collect()]
    prefixes = F.array(*[F.when(F.char_length("_word") >= n, F.substring("_word", 1, n)) for n in lengths] or [F.lit(None).cast("string")])
    hits = words.select("_k", "_dl", F.explode(F.array_compact(prefixes)).alias("term")).join(_small(asked), "term")
    # the postings of the asked terms are used twice, for their counts and for the scores
    tf = materialise(hits.groupBy("term", "_k").agg(F.count("*").alias("_tf"), F.first("_dl").alias("_dl")), "postings")
    df = tf.groupBy("term").agg(F.count("*").alias("_df"))
    scored = tf.join(_small(df), "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_dl") / F.col("_avg")))
    found = scored.select("term", "_k", weight.alias("_w")).join(_small(terms), "term").groupBy("query_id", "_k").agg(F.round(F.sum("_w"), 6).alias("lexical_score"))
    return ranked(found, "lexical_score", ["_k"], "lexical_rank", most).withColumnRenamed("_k", key)


def dense(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "vector", most: int = 20, block: int = 2048) -> DataFrame:
    """query_id, key, distance, vector_score, dense_rank: each query's nearest vectors by squared distance.

    Exact, by blocks: queries (query_id, vector) are packed into matrices of block rows, which are broadcast one by
    one while the vectors stream by; each task keeps its best of every query, so what is shuffled doesn't grow with
    the vectors but with tasks times queries.
    """
    import numpy as np
    import pandas as pd

    kind, of = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null")
    spark, found, part = vectors.sparkSession, None, []

    def search(ids: list, matrix: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, matrix))

        def run(batches):
            names, q = sent.value
            best_d = np.full((len(names), 0), np.inf)
            best_k = np.empty((len(names), 0), dtype=object)
            for batch in batches:
                if not len(batch):
                    continue
                x = np.stack(batch["v"].to_numpy()).astype(np.float64)
                d = np.round(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0), 6)
                k = np.broadcast_to(batch["k"].to_numpy(dtype=object)[None, :], d.shape)
                best_d, best_k = np.concatenate([best_d, d], 1), np.concatenate([best_k, k], 1)
                keys = np.array([[v for v in row] for row in best_k], dtype=object)
                order = np.array([sorted(range(best_d.shape[1]), key=lambda j, i=i: (best_d[i, j], keys[i, j]))[:most] for i in range(len(names))]) if best_d.shape[1] <= 4 * most else _best(best_d, keys, most)
                best_d, best_k = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_k, order, 1)
            for i, name in enumerate(names if best_d.shape[1] else []):
                yield pd.DataFrame({"query_id": [name] * best_d.shape[1], "k": list(best_k[i]), "distance": best_d[i]})

        return rows.mapInPandas(run, f"query_id {of}, k {kind}, distance double")

    for r in queries.select("query_id", "vector").where("vector is not null").toLocalIterator():
        part.append(r)
        if len(part) == block:
            one = search([x[0] for x in part], np.array([x[1] for x in part], dtype=np.float64))
            found, part = (one if found is None else found.union(one)), []
    if part or found is None:
        one = search([x[0] for x in part], np.array([x[1] for x in part], dtype=np.float64).reshape(len(part), -1))
        found = one if found is None else found.union(one)
    at = Window.partitionBy("query_id").orderBy("distance", "k")
    out = found.withColumn("dense_rank", F.row_number().over(at)).where(F.col("dense_rank") <= most)
    return out.select("query_id", F.col("k").alias(key), "distance", F.round(distance_score(F.col("distance")), 6).alias("vector_score"), "dense_rank")


def _best(d, keys, most: int):
    """Per row the columns of the most smallest values, equal ones in the order of their keys."""
    import numpy as np

    floor = np.partition(d, most - 1, axis=1)[:, most - 1]
    out = []
    for i in range(len(d)):
        near = np.flatnonzero(d[i] <= floor[i])
        out.append(sorted(near, key=lambda j, i=i: (d[i, j], keys[i, j]))[:most])
    return np.array(out)


def summary_hits(queries: DataFrame, vectors: DataFrame, depth: int, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, parent_id, summary_rank: the nearest summaries of each query, a third of depth and four at least; of a parent's several the nearest.

    vectors has key, vector, parent_id and source_kind, of which only summaries with a parent count.
    """
    rows = vectors.where("source_kind = 'summary' and parent_id is not null")
    near = dense(queries, rows.select(key, vector), key, vector, max(4, depth // 3)).join(rows.select(key, "parent_id").dropDuplicates([key]), key)
    return near.groupBy("query_id", "parent_id").agg(F.max("dense_rank").alias("summary_rank"))


def memory_hits(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "vector", most: int = 2) -> DataFrame:
    """query_id, key, vector_score, dense_rank: the two nearest memories of each query."""
    return dense(queries, vectors.where("source_kind = 'memory'").select(key, vector), key, vector, most).select("query_id", key, "vector_score", "dense_rank")


def summary_boost(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """results with the summary_rank of their parent: summaries has query_id, parent_id, summary_rank."""
    return results.join(summaries.select("query_id", "parent_id", "summary_rank"), ["query_id", "parent_id"], "left")


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, key: str = "id", most: int | None = None, k: int = RRF_K, parents: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """query_id, key, dense_rank, lexical_rank, fusion_score, fusion_rank by reciprocal ranks; a side may miss a row.

    With parents (key, parent_id) and summaries (query_id, parent_id, summary_rank) the rank of a row's parent among
    the summaries counts as a third one, summary_rank.
    """
    both = dense_hits.select("query_id", key, "dense_rank").join(lexical_hits.select("query_id", key, "lexical_rank"), ["query_id", key], "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    score = part("dense_rank") + part("lexical_rank")
    if summaries is not None and parents is not None:
        both = summary_boost(both.join(parents.select(key, "parent_id").dropDuplicates([key]), key, "left"), summaries).drop("parent_id")
        score = score + part("summary_rank")
    return ranked(both.withColumn("fusion_score", F.round(score, 9)), "fusion_score", ["dense_rank", "lexical_rank", key], "fusion_rank", most)


def merge_candidates(candidates: DataFrame, key: str = "id") -> DataFrame:
    """One row per query and key: the best score, the best of each rank, and the subqueries that found it."""
    return candidates.groupBy("query_id", key).agg(F.max("score").alias("score"), F.min("dense_rank").alias("dense_rank"), F.min("lexical_rank").alias("lexical_rank"), F.array_sort(F.collect_set("subquery_id")).alias("subquery_ids"))


def important_terms(prompt: Column) -> Column:
    return F.array_distinct(F.filter(words_of(prompt), lambda x: (F.char_length(x) >= 3) & ~x.isin(*QUERY_STOPWORDS)))


def prior_score(prompt: Column, text: Column, lexical_rank: Column, dense_rank: Column) -> Column:
    """What ranks and shared terms say before a reranker does: 3 falling by 0.12 for lexical places (0.5 at least), 0.8
    falling by 0.03 for dense ones (0.05 at least), 0.25 for each of the prompt's terms in the text (1 at most)."""
    lexical = F.when(lexical_rank.isNotNull(), F.greatest(F.lit(0.5), 3.0 - 0.12 * (lexical_rank - 1))).otherwise(0.0)
    near = F.when(dense_rank.isNotNull(), F.greatest(F.lit(0.05), 0.8 - 0.03 * (dense_rank - 1))).otherwise(0.0)
    shared = F.size(F.filter(important_terms(prompt), lambda t: F.lower(text).contains(t)))
    return F.round(lexical + near + F.least(F.lit(1.0), 0.25 * shared), 6)


def blended(raw: Column, prior: Column) -> Column:
    """A reranker's score and the prior, three to one; the prior alone where there is none."""
    return F.round(F.when(raw.isNull(), prior).otherwise(0.75 * raw + 0.25 * prior), 6)


def relevance_window(results: DataFrame, most: int, key: str = "id") -> DataFrame:
    """The most first results that pass: lexical hits, chunks of documents with lexical hits among the first, and scores
    of 0.75 and a fifth of the best. Where the first results hold no lexical hit, they are the answer.

    results has query_id, key, doc_id, score, lexical_rank and place (from 1)."""
    whole = Window.partitionBy("query_id")
    first = F.col("place") <= most
    hit = first & F.col("lexical_rank").isNotNull()
    marked = results.withColumn("_any", F.max(hit).over(whole)).withColumn("_top", F.max(F.when(F.col("place") == 1, F.col("score"))).over(whole))
    marked = marked.withColumn("_trusted", F.max(hit).over(Window.partitionBy("query_id", "doc_id")))
    passes = F.col("lexical_rank").isNotNull() | F.col("_trusted") | (F.col("score") >= F.greatest(F.lit(0.75), 0.2 * F.col("_top")))
    kept = marked.where(F.when(F.col("_any"), passes).otherwise(first))
    at = Window.partitionBy("query_id").orderBy("place")
    return kept.withColumn("_k", F.row_number().over(at)).where(F.col("_k") <= most).drop("_any", "_top", "_trusted", "_k")


def anchored_window(results: DataFrame, most: int, score: str = "score", key: str = "id") -> DataFrame:
    """The most best results, the dense search's first always among them, ahead of the others."""
    anchor = (F.col("dense_rank") == 1).cast("int")
    at = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(anchor, F.lit(0))), F.desc(score), key)
    return results.withColumn("window_rank", F.row_number().over(at)).where(F.col("window_rank") <= most)


# How a question asks for earlier conversations.
MEMORY_ONLY = r"(?i)\b(?:past|previous|earlier)\s+(?:conversation|chat)\s+only\b"
MEMORY_PREFERRED = r"(?i)\b(?:past|previous|earlier)\s+(?:conversation|chat)\b|\b(?:we\s+(?:just\s+)?discuss(?:ed)?|remember)\b"


def memory_mode(prompt: Column) -> Column:
    return F.when(prompt.rlike(MEMORY_ONLY), "only").when(prompt.rlike(MEMORY_PREFERRED), "preferred").otherwise("none")


def reserve_memory(results: DataFrame, mode: str = "mode", most: int = 10) -> DataFrame:
    """Where memory is preferred, the best memory takes the first place; where it is all that is asked for, only memories stay."""
    memory = F.col("source_kind") == "memory"
    kept = results.where((F.col(mode) != "only") | memory)
    best = F.row_number().over(Window.partitionBy("query_id", memory).orderBy(F.desc("score"), "id"))
    kept = kept.withColumn("_first", (F.col(mode) != "none") & memory & (best == 1))
    at = Window.partitionBy("query_id").orderBy(F.desc("_first"), F.desc("score"), "id")
    return kept.withColumn("place", F.row_number().over(at)).where(F.col("place") <= most).drop("_first")


def scope_settings(scope: str, top_k: int, top_n: int) -> tuple[int, int]:
    """Retrieval depth and context size for a scope: "low" at most 12 and 3, "high" at least 28 and 6."""
    return {"low": (min(top_k, 12), min(top_n, 3)), "high": (max(top_k, 28), max(top_n, 6))}.get(scope, (top_k, top_n))


def unused(candidates: DataFrame, selected: DataFrame, key: str = "id") -> DataFrame:
    return candidates.join(selected.select("query_id", key), ["query_id", key], "left_anti")


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """A deterministic embedding: each word adds one to the dimension that its SHA-256 names; length 1, or null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), F.lit(1))
    places = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("bigint"), F.lit(dimension)))
    # one fold over the words: a lambda that named the places would hash all words again for each dimension
    counts = F.aggregate(places, F.array_repeat(F.lit(0.0), dimension), lambda a, p: F.transform(a, lambda x, i: x + (i == p).cast("double")), lambda a: F.struct(a.alias("c"), F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    # the fold's result is handed on once, as the only element of an array
    return F.transform(F.array(counts), lambda r: F.when(r["n"] > 0, F.transform(r["c"], lambda x: x / r["n"])))[0]
