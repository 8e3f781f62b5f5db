from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm.splitting import split_oversized, split_pieces


def cut(spark, rows, unit="tokens"):
    df = spark.createDataFrame(rows, "t string, l int, o int")
    return [r.p for r in df.select(split_pieces(F.col("t"), F.col("l"), F.col("o"), unit).alias("p")).collect()]


def tokens(text):
    return re.findall(r"[^ \t\n\r]+", text)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "bb", "c.", "d,", "\n", "\n\n", "é!", "x" * 40]), max_size=60), st.integers(1, 9), st.integers(0, 12)), min_size=1, max_size=8))
def test_pieces_keep_all_tokens_within_the_limit(spark, cases):
    rows = [(" ".join(words), limit, overlap) for words, limit, overlap in cases]
    for (text, limit, overlap), pieces in zip(rows, cut(spark, rows), strict=True):
        whole = tokens(text)
        if len(whole) <= limit:
            assert [p.text for p in pieces] == [text]
            continue
        lap, end = min(overlap, limit - 1), 0
        for i, p in enumerate(pieces):
            own = tokens(p.text)
            assert len(own) == p.size <= limit and own == whole[p.start : p.start + p.size]
            assert p.overlap == (min(lap, p.start + p.overlap) if i else 0) and p.start + p.overlap == end
            end = p.start + p.size
        assert end == len(whole)


def test_the_strongest_boundary_is_taken(spark):
    [pieces] = cut(spark, [("one two three.\n\nfour five. six seven eight", 4, 0)])
    assert [p.text for p in pieces] == ["one two three.", "four five.", "six seven eight"]


def test_characters_fall_back_inside_a_word(spark):
    [pieces] = cut(spark, [("abcdefghij klm", 4, 1)], "chars")
    assert all(len(p.text) <= 4 for p in pieces) and pieces[0].text == "abc"
    assert "".join(p.text[p.overlap :] for p in pieces) == "abcdefghij klm"


@pytest.mark.parametrize("limit", [2048, 8192, 32_768])
@pytest.mark.parametrize("unit", ["tokens", "chars"])
def test_large_limits(spark, limit, unit):
    """Long runs are matched in a loop: neither depth nor time grows faster than the text."""
    text = " ".join(f"w{i % 97}{'.' if i % 13 == 0 else ''}" for i in range(80_000)) + " 𝒳é" * 100
    n = len(tokens(text)) if unit == "tokens" else len(text)
    [pieces] = cut(spark, [(text, limit, 100)], unit)
    assert max(p.size for p in pieces) <= limit and sum(p.size - p.overlap for p in pieces) == n
    assert all(p.text.rstrip().endswith(".") for p in pieces[:-1])


def test_blanks_only_and_trailing_boundaries(spark):
    rows = [("  \n ", 1, 0), ("  a b\n\nc", 2, 0), ("(see it.) then go on", 3, 0), ("a, b c d", 3, 0)]
    got = [[p.text for p in pieces] for pieces in cut(spark, rows)]
    assert got == [["  \n "], ["a b", "c"], ["(see it.)", "then go on"], ["a,", "b c d"]]
    assert [p.text for p in cut(spark, [(" \n\n a", 2, 0)], "chars")[0]] == [" \n", "\n ", "a"]


def test_nulls_empty_long_and_unknown_profile(spark, frame):
    assert cut(spark, [(None, 3, 0)]) == [None]
    assert [p.text for p in cut(spark, [("", 3, 0)])[0]] == [""]
    [pieces] = cut(spark, [("w " * 40_000, 150, 24)])
    assert max(p.size for p in pieces) <= 150 and sum(p.size - p.overlap for p in pieces) == 40_000
    items = frame([("a", "x y z", None), ("b", "x y z", "none such"), ("c", None, "p"), ("d", "x y z", "p"), ("d", "x y z", "p")], "id string, text string, chunking_profile string", "limit", "_k", "n_tokens")
    limits = frame([("default", 5, 0), ("p", 2, None)], "profile string, child_max_tokens int, child_overlap_tokens int")
    got = sorted((r.id, None if r.pieces is None else len(r.pieces)) for r in split_oversized(items, limits, "id").collect())
    assert got == [("a", 1), ("b", None), ("c", None), ("d", 2), ("d", 2)]
    assert split_oversized(items, limits, "id", oversized_only=True).count() == 2
    assert split_oversized(items.limit(0), limits, "id").count() == 0
