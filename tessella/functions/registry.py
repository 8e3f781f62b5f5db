"""Functions for SQL: table functions over the library's expressions, and text functions that the JVM lacks."""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: ends of sentences, lines
BREAKS = re.compile(r"(?<=[.!?])\s+|\n+")


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


@udtf(returnType=StructType([StructField("chunk_no", IntegerType()), StructField("text", StringType())]))
class ChunkDocument:
    """chunk_document(text, target, most) for SQL: sentences and lines packed to chunks of at most most words.

    DataFrames take tessella.functions.text.child_chunks, which stays in the JVM.
    """

    def eval(self, text: str, target: int, most: int):
        runs = [w[i : i + most] for u in BREAKS.split(text or "") if (w := u.split()) for i in range(0, len(w), most)]
        sizes = [len(r) for r in runs]
        chunk, held, of = 0, 0, []
        for n in sizes:
            if held and (held >= target or held + n > most):
                chunk, held = chunk + 1, 0
            held += n
            of.append(chunk)
        for k, group in groupby(zip(of, runs, strict=True), key=lambda x: x[0]):
            yield k, " ".join(w for _, r in group for w in r)


def register(spark: SparkSession) -> None:
    """nfkc_casefold(text) and the table function chunk_document(text, target, most)."""
    spark.udf.register("nfkc_casefold", nfkc_casefold)
    spark.udtf.register("chunk_document", ChunkDocument)
