from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessella.functions import numbers as N
from tessella.functions import text as T
from tessella.functions.registry import register


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


def test_estimates_and_splits(spark):
    assert one(spark, T.word_tokens(F.col("t")), t="a  b\nc") == 3 and one(spark, T.word_tokens(F.col("t")), t="") == 1
    assert one(spark, T.char_tokens(F.col("t")), t="abcde") == 2
    assert one(spark, T.split_sentences(F.col("t")), t="One. Two!  Three\n\nfour? ") == ["One.", "Two!", "Three", "four?"]
    assert one(spark, T.text_units(F.col("t")), t="A b. C d.\n\nx, 1\ny, 2\nz, 3") == ["A b.", "C d.", "x, 1", "y, 2", "z, 3"]
    assert one(spark, T.text_units(F.col("t")), t=None) is None


def test_chunks_keep_every_word(spark):
    text = " ".join(f"w{i}" for i in range(401))
    parents = one(spark, T.parent_chunks(F.col("t"), 100, 100), t=text)
    assert all(len(p.split()) <= 100 for p in parents) and " ".join(parents).split() == text.split()
    children = one(spark, T.child_chunks(F.col("t"), 32, 32), t=text)
    assert all(len(c.split()) <= 32 for c in children) and " ".join(children).split() == text.split()


def fold(text, target, most, overlap, glue):
    """Brute force: the packing rule over words, unit by unit."""
    units = []
    for s in re.split(r"(?<=[.!?])\s+|\n+", text):
        w = s.split()
        units += [s.strip()] if 0 < len(w) <= most else [" ".join(w[i : i + most]) for i in range(0, len(w), most)]
    out, now, n = [], [], 0
    for u in units:
        size = len(u.split())
        for closing in (True, False):
            if closing and now and n + size > most:
                out.append(glue.join(now))
                tail = glue.join(now).split()[-overlap:] if overlap else []
                now, n = ([" ".join(tail)] if tail else []), len(tail)
            elif not closing:
                now.append(u)
                n += size
                if n >= target:
                    out.append(glue.join(now))
                    tail = glue.join(now).split()[-overlap:] if overlap else []
                    now, n = ([" ".join(tail)] if tail else []), len(tail)
    return out + ([glue.join(now)] if now else [])


def test_packing_against_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "ccc.", "dd!", "e\n"]) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for target, most, overlap in ((10, 15, 0), (10, 15, 3), (20, 8, 2)):
        got = [r.x for r in df.select(T.child_chunks(F.col("t"), target, most, overlap).alias("x")).collect()]
        assert got == [fold(t, min(target, most), most, overlap, " ") for t in texts]
    got = [r.x for r in df.select(T.parent_chunks(F.col("t"), 20, 30).alias("x")).collect()]
    assert got == [fold(t, 20, 30, 0, "\n") for t in texts]


def test_terms_and_queries(spark):
    assert one(spark, T.term_set(F.col("t")), t="The Étude of the ÉTUDE and x_1 on it") == ["étude", "x_1"]
    assert one(spark, T.search_terms(F.col("t")), t="Which readings show gas?") == ["readings", "reading", "gas"]
    assert one(spark, T.term_root(F.col("t")), t="measured") == "measur" and one(spark, T.term_root(F.col("t")), t="x1234567") == "x1234567"
    parts = one(spark, T.subqueries(F.col("t")), t="Compare the quick fox with slow dogs and big cats; cite all sources")
    assert [p.id for p in parts] == ["q0", "q1", "q2"] and parts[1].text == "the quick fox with slow dogs"
    assert [p.id for p in one(spark, T.subqueries(F.col("t")), t="what is gas")] == ["q1"]


def test_small_expressions(spark):
    assert one(spark, T.strip_hidden(F.col("t")), t="a<think>x</think> b <THINK y>open") == "a b"
    assert one(spark, T.cited_ids(F.col("t")), t="x [[src:s2]] y [[SRC: S1]] [[src:S2]]") == ["S2", "S1"]
    assert one(spark, T.normalised_header(F.col("t"), F.col("i")), t=" Mass (kg) ", i=0) == "mass_kg" and one(spark, T.normalised_header(F.col("t"), F.col("i")), t="%%", i=2) == "column_3"
    assert one(spark, T.truncated(F.col("t"), 9), t="alpha beta gamma") == "alpha" and one(spark, T.truncated(F.col("t"), 10), t="alpha beta gamma") == "alpha beta"
    assert one(spark, T.stable_id("cell", F.col("a"), F.col("b")), a="x", b=3).startswith("cell-")
    blocks = one(spark, T.context_blocks(F.col("t")), t="One. Two.\n\n- a\n- b\n\n| x | y |")
    assert [b.kind for b in blocks] == ["prose", "prose", "structured", "structured"]
    assert one(spark, T.contextual_text(F.col("t"), F.col("n"), F.lit(None), F.lit(2), F.lit(3), F.lit("table")), t="x", n="Doc") == "Document: Doc\nPage: 2-3\nBlock type: table\n\nx"


def test_numbers(spark):
    for raw, want in (("100", "100"), ("1.50", "1.5"), ("0.00", "0"), ("-0.10", "-0.1"), ("0.00000012", "0.00000012")):
        assert one(spark, N.canonical_decimal(F.col("t").cast("decimal(38,18)")), t=raw) == want
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.x, 9) for r in df.select(N.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.0]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select nfkc_casefold('ＳtraßE') as x").first().x == "strasse"
    assert [r.text for r in spark.sql("select * from chunk_document('a b. c d. e f.', 4, 4)").collect()] == ["a b. c d.", "e f."]
