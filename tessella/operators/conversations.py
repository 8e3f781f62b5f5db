"""Conversations and what is kept about them: tags, sources of messages, memories, answer records, feedback, file states."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import strip_hidden

# How much of a turn a memory keeps, of an error a status, of a question a case, of a feedback its value.
PROMPT_KEPT, ANSWER_KEPT, ERROR_KEPT, QUESTION_KEPT, VALUE_KEPT = 1600, 3200, 50, 4000, 32


def with_tags(documents: DataFrame, tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """documents with tags, the sorted names that tags (key, tag) gives each; an empty array where it gives none."""
    of = tags.where("tag is not null").groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return documents.join(of, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def with_sources(messages: DataFrame, sources: DataFrame, *fields: str) -> DataFrame:
    """messages with sources, an array of structs of rank and fields in the order of ranks: sources has message_id and rank."""
    of = sources.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("sources"))
    return messages.join(of, "message_id", "left")


def memories(turns: DataFrame) -> DataFrame:
    """id, conversation_id, message_id, text, chunk_length, source_kind: what is remembered of each turn.

    turns has conversation_id, message_id, prompt, answer. Hidden reasoning goes first; where an answer is nothing
    else, it is kept as it is. A message gives one memory, named by it.
    """
    answer = F.coalesce(F.nullif(strip_hidden(F.col("answer")), F.lit("")), F.trim("answer"), F.lit(""))
    text = F.concat(F.lit("[Past Conversation Context]\nUser: "), F.substring(F.trim(F.coalesce("prompt", F.lit(""))), 1, PROMPT_KEPT), F.lit("\nAssistant: "), F.substring(answer, 1, ANSWER_KEPT))
    rows = turns.where("message_id is not null").dropDuplicates(["message_id"])
    return rows.select(F.concat(F.lit("mem_"), F.col("message_id").cast("string")).alias("id"), "conversation_id", "message_id", text.alias("text"), F.char_length(text).alias("chunk_length"), F.lit("memory").alias("source_kind"))


def forgotten(kept: DataFrame, conversations: DataFrame) -> DataFrame:
    """Memories without those of the conversations."""
    return kept.join(conversations.select("conversation_id").distinct(), "conversation_id", "left_anti")


def answer_records(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """answers, of each answer_id the latest, with query_id null where no such query is known: an answer outlives its query's trace."""
    last = answers.withColumn("_k", F.row_number().over(Window.partitionBy("answer_id").orderBy(F.desc("created_at"), F.desc("query_id")))).where("_k = 1").drop("_k")
    known = queries.where("query_id is not null").select(F.col("query_id").alias("_q")).distinct()
    return last.join(known, F.col("query_id") == F.col("_q"), "left").withColumn("query_id", F.col("_q")).drop("_q")


def cases_from_feedback(feedback: DataFrame) -> DataFrame:
    """feedback_id, question, expected_doc_id, status: pending cases of the feedback that says what was asked, or how it should be, and which document was expected."""
    question = F.trim(F.coalesce(F.nullif("question", F.lit("")), F.nullif("correction", F.lit("")), F.lit("")))
    expected = F.trim(F.coalesce(F.col("expected_doc_id").cast("string"), F.lit("")))
    return feedback.where((question != "") & (expected != "")).select("feedback_id", F.substring(question, 1, QUESTION_KEPT).alias("question"), expected.alias("expected_doc_id"), F.lit("pending").alias("status"))


def feedback_value(value: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.trim(value.cast("string")), 1, VALUE_KEPT), F.lit("")), F.lit("unknown"))


def with_latency(queries: DataFrame, latency: DataFrame) -> DataFrame:
    """queries with the milliseconds of their stages, as far as they were taken."""
    return queries.join(latency, "query_id", "left")


def config_hash(profile: str, settings: Mapping[str, Any]) -> str:
    """SHA-256 of a chunking profile and its settings, whatever their order."""
    return hashlib.sha256(json.dumps({"profile": profile, "settings": dict(settings)}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def status_after(error: Column) -> Column:
    return F.when(error.isNull(), "ready").otherwise(F.concat(F.lit("failed: "), F.substring(error, 1, ERROR_KEPT)))


def stale_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, reasons of the documents whose file is gone, or whose size or time and then content changed.

    documents has doc_id, path, size, modified_at, content_hash; files path, length, modified_at, content_hash (discover).
    """
    now = files.select("path", F.col("length").alias("_l"), F.col("modified_at").alias("_m"), F.col("content_hash").alias("_h")).dropDuplicates(["path"])
    rows = documents.join(now, "path", "left")
    moved = ~(F.col("size").eqNullSafe(F.col("_l")) & F.col("modified_at").eqNullSafe(F.col("_m")))
    reasons = F.array_compact(F.array(F.when(F.col("_h").isNull(), "file_missing"), F.when(F.col("_h").isNotNull() & moved & ~F.col("content_hash").eqNullSafe(F.col("_h")), "content_changed")))
    return rows.select("doc_id", reasons.alias("reasons")).where(F.size("reasons") > 0)
