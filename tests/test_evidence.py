from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessella import queries
from tessella.operators import evaluation, evidence, history, named


def statuses(frame, answer, sources):
    claims = evidence.verify_claims(frame([("a", answer)], "answer_id string, text string"), frame([("a", s, t) for s, t in sources], "answer_id string, source_id string, text string"))
    return [(r.claim_id, r.status, r.numeric_status) for r in claims.orderBy("claim_id").collect()]


def test_claims(frame):
    s1 = ("S1", "The filtration rate reached 81.7 percent in the second trial.")
    assert statuses(frame, "The filtration rate reached 81.7 percent in the trial. [[src:S1]]", [s1]) == [("C1", "entailed", "entailed")]
    assert statuses(frame, "The filtration rate reached 12 percent in the trial. [[src:S1]]", [s1]) == [("C1", "contradicted", "contradicted")]
    assert statuses(frame, "Zebras graze calmly beside distant mountains. [[src:S1]]", [s1]) == [("C1", "unsupported", "not_applicable")]
    assert statuses(frame, "The filtration rate reached new highs.", [s1]) == [("C1", "citation_missing", "not_applicable")]
    assert statuses(frame, "The filtration rate reached new highs. [[src:S9]]", [s1]) == [("C1", "unsupported", "not_applicable")]
    assert statuses(frame, "The filtration rate never reached percent in second trial. [[src:s1]]", [s1])[0][1] == "contradicted"


def test_derived_numbers_and_direction(frame):
    s1 = ("S1", "Latency went from 20 ms to 15 ms in the measured pipeline.")
    assert statuses(frame, "Measured pipeline latency fell by 25 percent. [[src:S1]]", [s1])[0][2] == "entailed"
    assert statuses(frame, "Pipeline latency difference measured was 5 ms. [[src:S1]]", [s1])[0][2] == "entailed"
    assert statuses(frame, "Measured pipeline latency increased to 15 ms. [[src:S1]]", [s1])[0][2] == "contradicted"


def test_accounting(frame):
    answers = frame([("a", "x [[src:S1]] y [[src:s1]] z [[src:S9]] [src:S2]"), ("b", None), ("c", "")], "answer_id string, text string")
    sources = frame([("a", "S1"), ("a", "S2")], "answer_id string, source_id string")
    got = {r.answer_id: r for r in evidence.citation_accounting(answers, sources).collect()}
    a = got["a"]
    assert (a.citation_count, a.unique_count, a.valid_count, a.invalid_count, a.repeated_ids, a.malformed_count, a.uncited_count, a.precision) == (3, 2, 1, 1, "S1", 1, 1, 0.5)
    assert got["c"].citation_count == 0 and got["c"].precision == 0.0


def test_cells_ledger_conflicts_context(spark, frame):
    df = spark.createDataFrame([("sum", 60.0, "kg", [10.0, 20.0, 30.0], "kg"), ("mean", 21.0, "kg", [10.0, 20.0, 30.0], "kg"), ("max", 30.0, "m", [10.0, 30.0], "kg"), ("min", 1.0, None, [], None)], "op string, v double, u string, vs array<double>, cu string")
    assert [r.x for r in df.select(evidence.cell_check(F.col("op"), F.col("v"), F.col("u"), F.col("vs"), F.col("cu")).alias("x")).collect()] == ["entailed", "contradicted", "unit_mismatch", "missing_cell"]
    needs = evidence.requirements(frame([("q", "“Deep Log” and “Old Report” results"), ("r", "quick red foxes and slow grey dogs")], "query_id string, text string"))
    assert {(r.query_id, r.text, r.named) for r in needs.collect()} == {("q", "Deep Log", True), ("q", "Old Report", True), ("r", "quick red foxes", False), ("r", "slow grey dogs", False)}
    got = {r.text if "text" in r else r.requirement_id: r.status for r in evidence.ledger(needs.where("query_id = 'r'"), frame([("r", "S1", "quick red foxes ran")], "query_id string, source_id string, text string")).collect()}
    assert sorted(got.values()) == ["missing", "sufficient"]
    rows = frame([("q", "S1", 1, "the valve opened during the storm"), ("q", "S2", 2, "the valve never opened during the storm"), ("q", "S3", 2, "rivers carry stone")], "query_id string, source_id string, doc_id bigint, text string")
    assert [(r.left_id, r.right_id) for r in evidence.conflicts(rows).collect()] == [("S1", "S2")]
    parts = spark.createDataFrame([("[[src:s1]] one two [[src:S2]] three",)], "t string").select(evidence.sources_from_context(F.col("t")).alias("x")).first().x
    assert [(p.source_id, p.text) for p in parts] == [("S1", "one two"), ("S2", "three")]


def test_confidence_staleness_rollup(frame, spark):
    rows = [("s", 1, 0.9, 0.8, 0.9, 3.0), ("s", 2, 0.7, 0.7, None, None), ("w", 1, 0.01, 0.0, 0.05, None)]
    got = {r.query_id: r for r in evaluation.confidence(frame(rows, "query_id string, doc_id bigint, score double, rerank_score double, vector_score double, lexical_score double")).collect()}
    assert not got["s"].no_answer and got["s"].uncertainty in ("low", "medium")
    assert got["w"].no_answer and got["w"].reasons == ["low_rerank_score", "low_vector_score", "low_confidence"]
    df = spark.createDataFrame([(("a", None), ("a", None)), (("a", "x"), ("b", None))], "stored struct<content_hash:string,parser_version:string>, current struct<content_hash:string,parser_version:string>")
    fields = tuple(x for x in evaluation.STALE if x[0] in ("content_hash", "parser_version"))
    assert [r.x for r in df.select(evaluation.stale_reasons("stored", "current", fields).alias("x")).collect()] == [[], ["file_hash_changed", "parser_version_changed"]]
    jobs = frame([("r", "succeeded"), ("r", "failed"), ("s", "running"), ("t", "cancelled")], "run_id string, status string")
    assert {r.run_id: r.status for r in evaluation.run_rollup(jobs).collect()} == {"r": "completed_with_errors", "s": "running", "t": "cancelled"}


def test_answers(frame):
    rows = [("Insufficient evidence in the text.", True, [], [], []), ("It was 12 kg [[src:S1]]", False, ["12 KG"], ["S1", "S9"], ["S1"])]
    got = [r.metrics for r in evaluation.answer_metrics(frame(rows, "answer string, expected_refusal boolean, accepted array<string>, cited array<string>, available array<string>")).collect()]
    assert got[0] == {"correct_refusal": 1.0, "over_refusal": 0.0}
    assert got[1] == {"correct_refusal": 1.0, "over_refusal": 0.0, "accepted_answer_match": 1.0, "citation_precision": 0.5, "invalid_citation_rate": 0.5}


def test_history_and_records(frame, spark):
    text = "2025/08/13 1/2\n2025/08/14 19747776/177090636\n2024/01/01 5\nnot 2024/01/01"
    assert history.largest_record(frame([(1, text), (2, None)], "doc_id bigint, text string"), "text", "total", "doc_id").collect()[0].asDict() == {"doc_id": 1, "date": "2025-08-14", "value": 19747776 + 177090636}
    df = spark.createDataFrame([("197.5 ± 3.8 km, 14.0 +/- 3.2 km; 33M not 40m, 0. 02 M, 5 km",)], "t string")
    assert df.select(history.unit_values(F.col("t"), "km").alias("x")).first().x == ["197.5 ± 3.8", "14.0 +/- 3.2", "5"]
    assert df.select(history.unit_values(F.col("t"), "M").alias("x")).first().x == ["33", "0.02"]
    messages = frame([(i,) for i in range(1, 6)], "id bigint")
    assert [(r.id, r.has_more) for r in history.page_before(messages, None, 2).collect()] == [(4, True), (5, True)]
    assert [(r.id, r.has_more) for r in history.page_before(messages, 3, 2).collect()] == [(1, False), (2, False)]
    turns = frame([(1, 0, "user", "x" * 40), (1, 1, "assistant", "y" * 400), (1, 2, "user", "z" * 40)], "conversation_id bigint, turn bigint, role string, text string")
    assert [r.turn for r in history.history_budget(turns, 100).orderBy("turn").collect()] == [0, 2]


def test_conflicts_against_all_pairs(spark, frame):
    """Sources of one query in any number, held against every pair of them."""
    rng = random.Random(1)
    words = [f"term{chr(97 + i)}" for i in range(26)]
    rows = []
    for q in range(4):
        for i in range(40):
            text = " ".join(rng.sample(words[6 * q : 6 * q + 8], 5)) + (" never" if rng.random() < 0.4 else "")
            rows.append((f"q{q}", f"s{i:02}", i % 7, text))
    sets = {(q, s): (d, set(t.split()) - {"never"}, "never" in t) for q, s, d, t in rows}
    want = {(q, a, b) for (q, a), x in sets.items() for (p, b), y in sets.items() if q == p and a < b and x[0] != y[0] and x[2] != y[2] and len(x[1] & y[1]) >= 0.45 * len(x[1] | y[1])}
    found = evidence.conflicts(frame(rows + rows[:3], "query_id string, source_id string, doc_id bigint, text string"))
    assert {(r.query_id, r.left_id, r.right_id) for r in found.collect()} == want and len(want) > 100 and found.count() == len(want)


def test_registered_conflicts_look_at_every_reranked_source(spark, monkeypatch):
    places = [("q", f"c{i:02}", i, i) for i in range(1, 31)]
    stage = spark.createDataFrame(places, "query_id string, chunk_id string, doc_id bigint, place int")
    texts = spark.createDataFrame([(f"c{i:02}", i, "the valve never opened during the storm" if i == 30 else "the valve opened during the storm" if i == 1 else f"rivers carry stone{i}") for i in range(1, 31)], "id string, doc_id int, text string")
    monkeypatch.setattr(queries, "_questions", lambda *_: spark.createDataFrame([("z", "zebra herds")], "query_id string, text string"))
    monkeypatch.setattr(queries, "_sources", lambda *_: None)
    monkeypatch.setattr(queries, "_stage", lambda *_: stage)
    monkeypatch.setattr(queries, "_chunks", lambda *_: texts)
    assert [(r.left_id, r.right_id) for r in queries.evidence_conflicts(spark, "").collect()] == [("c01", "c30")]


def test_conflicts_of_values_and_their_requirements(frame):
    many = " ".join(f"{i} mm" for i in range(40))
    rows = [("q", "S1", 1, "the pump valve held 12 kg during trials"), ("q", "S2", 2, "the pump valve held 15 kilograms during trials"), ("q", "S3", 3, "the pump valve held 12.005 kg during trials"), ("q", "S4", 1, "the pump valve held 99 kg during trials"), ("q", "S5", 4, "the pump valve held 15 ms during trials"), ("r", "S1", 1, f"length of steel {many} 7 kg"), ("r", "S2", 2, f"length of steel {many} 9 kg")]
    evidence_rows = frame(rows, "query_id string, source_id string, doc_id bigint, text string")
    got = {(r.query_id, r.left_id, r.right_id, r.reason) for r in evidence.conflicts(evidence_rows).collect()}
    assert got == {("q", "S1", "S2", "values"), ("q", "S2", "S3", "values"), ("q", "S2", "S4", "values"), ("q", "S3", "S4", "values"), ("r", "S1", "S2", "values")}
    needs = frame([("q", "r1", "pump valve"), ("q", "r2", "zebra herds")], "query_id string, requirement_id string, text string")
    assert {(r.requirement_id, r.status) for r in evidence.ledger(needs, evidence_rows).collect()} == {("r1", "conflicting"), ("r2", "missing")}


def test_named_documents_and_their_needs(spark):
    prompts = ["Results of “Deep Log: a study” and 'old report'.", 'Use the Long River as the target paper', "What was said?", "Compare \"Deep Log\" with “deep log”", None]
    rows = spark.createDataFrame([(p,) for p in prompts], "p string").select(named.targets(F.col("p")).alias("t"), named.needs(F.col("p")).alias("n")).collect()
    assert [r.t for r in rows] == [["Deep Log: a study", "old report"], ["Long River"], [], ["Deep Log"], []]
    assert rows[0].n == ["result"] and len(rows[2].n) == 4
    cases = [("Deep Log: a study", ["library/deep_log.pdf"], False), ("Deep Log: a study", ["Deep log.PDF"], True), ("Astronomy 02 survey", ["astronomy-survey-x.pdf"], True), ("Pulsar", ["notes on pulsar.txt"], True), ("Sun", ["the sun also"], True), ("Io", ["notes io"], True), ("xy", ["x y"], False), ("Deep", [None], False)]
    got = spark.createDataFrame(cases, "t string, n array<string>, w boolean").select("w", named.is_document(F.col("t"), F.col("n")).alias("g")).collect()
    assert [r.g for r in got] == [w for _, _, w in cases]


def test_fits(frame):
    good = "We propose a method that improves the recall of search over long and noisy archives by a wide margin in all trials."
    rows = [("q", "a", good, ["deep log.pdf", None]), ("q", "b", "References doi: 10.1", ["deep log.pdf"]), ("q", "c", good, ["other.pdf"]), ("q", "d", None, ["deep log.pdf"])]
    needs = frame([("q", "r1", "Deep log", ["method", "limitation"]), ("q", "r2", "Deep log", ["limitation"])], "query_id string, requirement_id string, title string, needs array<string>")
    got = {r.id: r.fits for r in named.fits(frame(rows, "query_id string, id string, text string, names array<string>", "share"), needs).collect()}
    assert got == {"a": {"r1": 0.5}, "b": None, "c": None, "d": None}


def test_direction_of_comparisons(spark):
    cases = [("A is greater than B", ["Greater"], "entailed"), ("A is less", ["greater"], "contradicted"), ("A differs", ["less"], "ambiguous_operation"), ("A is less", None, "not_applicable")]
    rows = spark.createDataFrame(cases, "c string, r array<string>, w string").select("w", evidence.direction_check(F.col("c"), F.col("r")).alias("g")).collect()
    assert all(r.w == r.g for r in rows)
