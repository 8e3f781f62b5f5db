from __future__ import annotations

import random
import statistics

import pytest

from tessella.llm.rank_fusion import best_of_groups, rank_fusion

SCHEMA = "query_id string, stage string, chunk_id string, score double"


def brute(rows):
    """Ranks with ties at their mean, absent ones behind all, median then mean then id."""
    best = {}
    for q, s, c, v in rows:
        if None in (q, s, c, v) or v != v:
            continue
        v = -v if s == "distance" else v
        best[q, s, c] = max(v, best.get((q, s, c), v))
    out = {}
    for q in {k[0] for k in best}:
        stages = {k[1] for k in best if k[0] == q}
        for c in {k[2] for k in best if k[0] == q}:
            ranks = []
            for s in stages:
                own = {k[2]: v for k, v in best.items() if k[:2] == (q, s)}
                ranks.append(len(own) + 1 if c not in own else sum(v > own[c] for v in own.values()) + (sum(v == own[c] for v in own.values()) + 1) / 2)
            out[q, c] = (statistics.median(ranks), statistics.mean(ranks))
    return out


def test_against_brute_force(frame):
    rng = random.Random(3)
    rows = [(f"q{q}", s, f"c{c}", rng.choice([0.1, 0.5, 2.0, 7.0, rng.random() * 100])) for q in range(6) for s in ("distance", "bm25", "fusion", "rerank") for c in range(12) if rng.random() < 0.8]
    got = {(r.query_id, r.chunk_id): (r.median_rank, r.mean_rank) for r in rank_fusion(frame(rows + rows[:9], SCHEMA)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    first = {r.query_id: r.chunk_id for r in best_of_groups(frame(rows, SCHEMA)).collect()}
    for q in first:
        assert first[q] == min((v, c) for (p, c), v in want.items() if p == q)[1]


def test_nulls_nan_empty_and_clashing_columns(frame):
    rows = [("q", "bm25", "a", None), ("q", "bm25", "b", float("nan")), ("q", "bm25", "c", 1.0), (None, "bm25", "c", 1.0), ("q", None, "c", 1.0), ("q", "bm25", None, 9.0), ("q", "rerank", "a", 5.0)]
    got = {r.chunk_id: r.median_rank for r in rank_fusion(frame(rows, SCHEMA, "_rank", "_g", "rank", "_range")).collect()}
    assert got == {"a": 1.5, "c": 1.5}
    assert best_of_groups(frame([], SCHEMA)).count() == 0


def test_weights(frame):
    rows = [("q", "x", "a", 9.0), ("q", "x", "b", 1.0), ("q", "y", "a", 1.0), ("q", "y", "b", 9.0)]
    assert best_of_groups(frame(rows, SCHEMA), weights={"y": 3.0}).first().chunk_id == "b"
    assert best_of_groups(frame(rows, SCHEMA), weights={"x": 3.0}).first().chunk_id == "a"
    with pytest.raises(ValueError):
        rank_fusion(frame(rows, SCHEMA), weights={"x": 0.0})


def test_a_group_that_holds_most_rows_is_spread(frame):
    rows = [("hot", "bm25", f"c{i:05}", float(i % 900)) for i in range(3000)] + [("q", "bm25", "c", 1.0)]
    assert {r.query_id: r.chunk_id for r in best_of_groups(frame(rows, SCHEMA)).collect()} == {"hot": "c00899", "q": "c"}


def test_places_have_no_gaps_in_any_group(spark, frame):
    from tessella.llm.rank_fusion import ranking

    rows = [("hot", s, f"c{i:03}", float((i * 7919) % 400)) for i in range(400) for s in ("a", "b")] + [("q", "a", "x", 1.0), ("q", "b", "y", 1.0)]
    got = ranking(frame(rows, "query_id string, stage string, chunk_id string, score double", "place", "_range")).collect()
    for group in ("hot", "q"):
        own = sorted((r.place, r.median_rank, r.mean_rank, r.chunk_id) for r in got if r.query_id == group)
        assert [p for p, *_ in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert ranking(frame([], "query_id string, stage string, chunk_id string, score double")).count() == 0
