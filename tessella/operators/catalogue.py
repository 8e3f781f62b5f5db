"""What surrounds retrieval: routing of prompts, payloads of documents, usage counters, rendered unit answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What in a prompt speaks for documents, and what against them.
DOCUMENT_CUES = ("according to", "citation", "cite ", "document", "file", "local source", "my notes", "paper", "pdf", "report", "research", "source", "spreadsheet", "table", "uploaded")
OTHER_CUES = ("brainstorm", "draft ", "help me write", "make up", "proofread", "rewrite", "roleplay", "tell me a joke", "translate")
GREETING = r"^(?:hi|hello|hey|thanks|thank you|good (?:morning|afternoon|evening))[!. ]*$"
PREVIEW, PREVIEW_CHARACTERS, MOST_VALUES = 20, 500, 24


def retrieval_route(prompt: Column, scope: Column, evidence_required: Column | bool = False) -> Column:
    """low, medium, high or off: the scope that is asked for; for "auto" and null, what the prompt speaks for."""
    clean = F.lower(F.trim(F.regexp_replace(prompt, r"\s+", " ")))
    asked = F.lower(F.coalesce(scope, F.lit("auto")))
    required = evidence_required if isinstance(evidence_required, Column) else F.lit(evidence_required)

    def any_of(cues: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for cue in cues:
            out = out | clean.contains(cue)
        return out

    short = (F.size(F.split(clean, " ")) <= 4) & ~clean.endswith("?")
    return F.when(asked.isin("low", "medium", "high", "off"), asked).when(required | any_of(DOCUMENT_CUES), "medium").when(clean.rlike(GREETING) | any_of(OTHER_CUES) | short, "off").otherwise("medium")


def document_payloads(documents: DataFrame, chunks: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """doc_id, name, n_chunks, preview array<struct<chunk_index, id, text>> of each document: its first chunks, cut to 500 characters."""
    at = Window.partitionBy("doc_id").orderBy("chunk_index", "id")
    first = chunks.withColumn("_k", F.row_number().over(at)).where(F.col("_k") <= preview)
    shown = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", F.substring("text", 1, PREVIEW_CHARACTERS).alias("text")))).alias("preview"))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    named = documents.select("doc_id", F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.element_at(F.split("path", "/"), -1)).alias("name"))
    return named.join(counts, "doc_id", "left").join(shown, "doc_id", "left").select("doc_id", "name", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "preview")


def retrieval_counts(documents: DataFrame, retrieved: DataFrame) -> DataFrame:
    """doc_id, retrieval_count of all documents: in how many queries each was retrieved."""
    n = retrieved.select("query_id", "doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("_n"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("_n", F.lit(0)).alias("retrieval_count"))


def unit_answers(values: DataFrame) -> DataFrame:
    """query_id, answer from the values (query_id, place, source_id, value) found for a unit: one is stated, several are listed and none is guessed among."""
    at = Window.partitionBy("query_id", "value").orderBy("place")
    once = values.withColumn("_f", F.row_number().over(at)).where("_f = 1")
    kept = once.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "value"))).where(F.col("_k") <= MOST_VALUES)
    item = F.concat(F.lit("**"), F.col("value"), F.lit("** [[src:"), F.col("source_id"), F.lit("]]"))
    of = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", item.alias("t")))), lambda x: x["t"]).alias("_items"))
    listed = F.concat(F.lit("The document states several values in that unit:\n- "), F.array_join("_items", "\n- "), F.lit("\nWhich is meant the question doesn't say."))
    return of.select("query_id", F.when(F.size("_items") == 1, F.concat(F.lit("The document states "), F.col("_items")[0], F.lit("."))).otherwise(listed).alias("answer"))
