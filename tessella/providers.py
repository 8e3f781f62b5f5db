"""What models supply, as protocols over columns and DataFrames, with deterministic stand-ins."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.numbers import cosine
from tessella.functions.text import containment, term_set
from tessella.operators.retrieval import hashed_embedding


class Embedder(Protocol):
    model_id: str
    dimension: int

    def embed(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, prompt: Column, text: Column) -> Column: ...


class Completer(Protocol):
    def complete(self, prompts: DataFrame) -> DataFrame: ...


class HashEmbedder:
    """Words hashed to dimensions; stays in the JVM."""

    model_id = "hash-64"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, text: Column) -> Column:
        return hashed_embedding(text, self.dimension)


class OverlapReranker:
    """The share of a prompt's terms that a text has."""

    def score(self, prompt: Column, text: Column) -> Column:
        return F.round(containment(term_set(prompt), term_set(text)), 6)


def embed_once(rows: DataFrame, embedder: Embedder, key: str, text: str = "text") -> DataFrame:
    """key, vector: equal texts, but for blanks, are embedded once and joined back."""
    squeezed = rows.select(key, F.trim(F.regexp_replace(text, r"\s+", " ")).alias("_t")).withColumn("_h", F.sha2("_t", 256))
    vectors = squeezed.dropDuplicates(["_h"]).select("_h", embedder.embed(F.col("_t")).alias("vector"))
    return squeezed.join(vectors, "_h").select(key, "vector")


def checked_vectors(rows: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """rows with vector_error: wrong dimension, not finite, or without length; null where a vector is fit to store."""
    v = F.col(vector)
    error = F.when(v.isNull() | (F.size(v) != dimension), "wrong_dimension").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").when(~F.exists(v, lambda x: x != 0), "zero_vector")
    return rows.withColumn("vector_error", error)


__all__ = ["Completer", "Embedder", "HashEmbedder", "OverlapReranker", "Reranker", "checked_vectors", "cosine", "embed_once"]
