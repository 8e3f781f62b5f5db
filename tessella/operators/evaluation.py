"""Evaluation and observability: ranking metrics, answers, index health, staleness, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.numbers import clamp, ratio
from tessella.functions.text import split_sentences, term_set


def ranking_metrics(results: DataFrame, gold: DataFrame, k: int = 10, key: str = "id") -> DataFrame:
    """query_id, recall_at_k, precision_at_k, mrr, ndcg_at_k, hits of each query that has gold.

    results has query_id, key, place (from 1); gold query_id, key. A target counts once, at its best place; precision
    is over what was retrieved, k at most. All rounded to 6 decimals.
    """
    gold = gold.select("query_id", key).distinct()
    window = results.where(F.col("place") <= k)
    best = window.join(gold, ["query_id", key]).groupBy("query_id", key).agg(F.min("place").alias("_p"))
    found = best.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("_p").alias("_first"), F.sum(1.0 / F.log2(F.col("_p") + 1.0)).alias("_dcg"))
    seen = window.groupBy("query_id").agg(F.count("*").alias("_n"))
    of = gold.groupBy("query_id").agg(F.count("*").alias("_targets")).join(seen, "query_id", "left").join(found, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_targets"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    hits = F.coalesce("hits", F.lit(0))
    return of.select("query_id", hits.alias("hits"), ratio(hits, F.col("_targets")).alias("recall_at_k"), ratio(hits, F.coalesce("_n", F.lit(0))).alias("precision_at_k"), F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("_dcg", F.lit(0.0)) / ideal, 6).alias("ndcg_at_k"))


def metric_means(metrics: DataFrame, *by: str) -> DataFrame:
    """by, metric, mean, n: each metric's mean over the rows that have it. metrics has a column metrics map<string,double>.

    Several grouping columns are each averaged alone, in one pass by grouping sets; the column grouped by is named.
    """
    rows = metrics.select(*by, F.explode("metrics").alias("metric", "value")).where("value is not null")
    if len(by) < 2:
        return rows.groupBy(*by, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    sets = rows.groupingSets([["metric", c] for c in by], "metric", *by).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(by)])
    field, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(by):
        field, group = F.when(F.col(f"_g{i}") == 0, c).otherwise(field), F.when(F.col(f"_g{i}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("unspecified"))).otherwise(group)
    return sets.select(field.alias("field"), group.alias("group"), "metric", "mean", "n")


# How a refusal reads.
REFUSALS = ("insufficient evidence", "could not find sufficient supporting evidence", "not enough evidence", "cannot determine", "can't determine", "not provided in the sources")
REFUSAL_STARTS = ("the retrieved documents do not contain", "the provided documents do not contain", "the retrieved sources do not contain", "the provided sources do not contain", "none of the retrieved sources reference", "none of the provided sources reference", "none of the indexed sources reference", "i was unable to find")


def refuses(answer: Column) -> Column:
    low, out = F.lower(F.trim(answer)), F.lit(False)
    for m in REFUSALS:
        out = out | low.contains(m)
    for m in REFUSAL_STARTS:
        out = out | low.startswith(m)
    return out


def requirement_met(terms: Column, answer: Column, mode: Column) -> Column:
    """All of a requirement's terms in the answer, or any where the mode says so; none asked for is not met."""
    low = F.lower(answer)
    there = F.filter(terms, lambda t: low.contains(F.lower(t)))
    return F.when(F.size(terms) == 0, F.lit(False)).when(mode == "any", F.size(there) > 0).otherwise(F.size(there) == F.size(terms))


def number_met(expected: Column, tolerance: Column, unit: Column, answer: Column) -> Column:
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.lower(answer).contains(F.lower(F.coalesce(unit, F.lit("")))) & F.exists(found, lambda x: F.coalesce(F.abs(x - expected) <= tolerance, F.lit(False)))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """answers with metrics map<string,double>; what doesn't apply is left out of the map.

    answers has answer, expected_refusal, accepted array<string>, cited array<string>, available array<string>.
    """
    refused, asked = refuses(F.col("answer")), F.coalesce("expected_refusal", F.lit(False))
    low = F.lower("answer")
    accepted = F.filter(F.coalesce("accepted", F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    match = F.when(asked, refused).otherwise(F.exists(accepted, lambda a: low.contains(F.lower(a))))
    cited = F.array_distinct(F.coalesce("cited", F.array().cast("array<string>")))
    valid = F.size(F.array_intersect(cited, F.coalesce("available", F.array().cast("array<string>"))))
    entry = lambda name, value, when=None: F.struct(F.lit(name).alias("k"), (value if when is None else F.when(when, value)).cast("double").alias("v"))
    all_ = F.array(entry("correct_refusal", (refused == asked).cast("int")), entry("over_refusal", (refused & ~asked).cast("int")), entry("accepted_answer_match", match.cast("int"), F.size(accepted) > 0), entry("citation_precision", ratio(valid, F.size(cited)), F.size(cited) > 0), entry("invalid_citation_rate", ratio(F.size(cited) - valid, F.size(cited)), F.size(cited) > 0))
    return answers.withColumn("metrics", F.map_from_entries(F.filter(all_, lambda e: e["v"].isNotNull())))


def quality_estimates(query: Column, answer: Column, context: Column) -> Column:
    """struct<context_relevance, groundedness, answer_relevance> from shared terms alone."""
    terms = lambda t: term_set(t, (), 3)
    asked, known = terms(query), terms(context)

    def overlap(a: Column, b: Column) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)

    read, said = split_sentences(context), split_sentences(answer)
    relevant = F.size(F.filter(read, lambda s: overlap(terms(s), asked) > 0))
    grounded = F.size(F.filter(said, lambda s: overlap(terms(s), known) >= 0.35))
    return F.struct(ratio(relevant, F.size(read)).alias("context_relevance"), ratio(grounded, F.size(said)).alias("groundedness"), F.round(overlap(terms(answer), asked), 6).alias("answer_relevance"))


def confidence(sources: DataFrame, least_rerank: float = 0.1, least_vector: float = 0.2, least_sources: int = 1, least: float = 0.35) -> DataFrame:
    """query_id, confidence, uncertainty, no_answer, reasons: whether a query's sources can carry an answer.

    sources has query_id, doc_id, score, rerank_score, vector_score, lexical_score.
    """
    at = Window.partitionBy("query_id").orderBy(F.desc("score"))
    two = sources.withColumn("_k", F.row_number().over(at))
    of = two.groupBy("query_id").agg(
        F.count("*").alias("_n"),
        F.coalesce(F.max("rerank_score"), F.max("score")).alias("_rerank"),
        F.max("vector_score").alias("_vector"),
        (F.max(F.when(F.col("_k") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("_k") == 2, F.col("score"))), F.lit(0.0))).alias("_gap"),
        F.count_distinct("doc_id").alias("_docs"),
        F.max(F.col("vector_score").isNotNull() & F.col("lexical_score").isNotNull()).alias("_both"),
    )
    base = 0.25 + F.least(F.greatest(F.col("_rerank"), F.lit(0.0)), F.lit(1.5)) * 0.22
    near = F.when(F.col("_vector").isNotNull(), clamp(F.col("_vector")) * 0.18).when(F.col("_rerank") >= least_rerank, F.lit(0.08)).otherwise(0.0)
    value = F.round(clamp(base + near + clamp(F.col("_gap")) * 0.12 + F.least(F.col("_docs"), F.lit(3)) * 0.06 + F.when(F.col("_both"), F.lit(0.12)).otherwise(0.0)), 4)
    weak = F.col("_rerank") < least_rerank
    of = of.withColumn("confidence", value)
    few, low = F.col("_n") < least_sources, F.col("confidence") < least
    reasons = F.array_compact(F.array(F.when(few, "too_few_sources"), F.when(weak, "low_rerank_score"), F.when((F.col("_vector") < least_vector) & weak, "low_vector_score"), F.when(~F.col("_both") & (F.col("_n") > 1) & (F.col("confidence") < 0.55) & weak, "low_vector_bm25_agreement"), F.when(low, "low_confidence")))
    return of.select("query_id", "confidence", F.when(F.col("confidence") < 0.45, "high").when(F.col("confidence") < 0.7, "medium").otherwise("low").alias("uncertainty"), (few | low).alias("no_answer"), reasons.alias("reasons"))


# What makes a document stale, in the order of the reasons.
STALE = (("content_hash", "file_hash_changed"), ("chunking_config_hash", "chunking_config_changed"), ("parser_version", "parser_version_changed"), ("embedding_model_id", "embedding_model_changed"), ("embedding_config_hash", "embedding_config_changed"))


def stale_reasons(stored: str, current: str, fields: tuple[tuple[str, str], ...] = STALE) -> Column:
    """array<string> for rows in which structs or table aliases named stored and current hold both states; nulls are equal to nulls."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{stored}.{k}").eqNullSafe(F.col(f"{current}.{k}")), reason) for k, reason in fields]))


def duplicate_rate(rows: DataFrame, text: str = "text") -> DataFrame:
    """n, duplicates, duplicate_rate: the share of rows that repeat another's text."""
    of = rows.groupBy(text).agg(F.count("*").alias("_c")).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicates"))
    return of.withColumn("duplicate_rate", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.round(F.col("duplicates") / F.col("n"), 6)))


def index_health(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: counts, failures, lengths of chunks (mean, median, least, greatest), duplicates."""
    docs = documents.agg(F.count("*").alias("document_count"), F.count_if(F.col("status").startswith("failed")).alias("failed_count"), F.count_if(F.col("status") == "ready").alias("ready_count"))
    length = F.coalesce("char_count", F.char_length("text"))
    parts = chunks.agg(F.count("*").alias("chunk_count"), F.count("embedding_model_id").alias("embedded_count"), F.round(F.avg(length), 2).alias("average_length"), F.median(length).alias("median_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"))
    repeats = duplicate_rate(chunks.where("text is not null")).select(F.col("duplicates").alias("duplicate_count"), "duplicate_rate")
    return docs.crossJoin(parts).crossJoin(repeats)  # a row each


def corpus_snapshot(documents: DataFrame) -> DataFrame:
    """kind, documents: how many documents of each kind of file there are."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("pdf", "docx", "xlsx", "csv"), ext).when(ext == "md", "markdown").when(ext == "txt", "text").when(ext.isin("py", "js", "ts", "html", "json"), "code").otherwise("other")
    return documents.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("documents"))


def run_rollup(jobs: DataFrame) -> DataFrame:
    """run_id, a count of each state, status: of jobs (run_id, status). Works on streams too."""
    states = ("queued", "running", "succeeded", "failed", "cancelled")
    of = jobs.groupBy("run_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    done = F.col("queued") + F.col("running") == 0
    status = F.when(~done, "running").when(F.col("cancelled") == F.col("total"), "cancelled").when(F.col("failed") > 0, "completed_with_errors").otherwise("completed")
    return of.withColumn("status", status)
