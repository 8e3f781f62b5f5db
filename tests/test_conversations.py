from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import conversations as C


def test_tags_sources_and_latency(frame):
    docs = frame([(1, "a"), (2, "b")], "doc_id bigint, name string", "tag")
    tags = frame([(1, "z"), (1, "y"), (1, "z"), (3, "x"), (2, None)], "doc_id bigint, tag string")
    assert {r.doc_id: r.tags for r in C.with_tags(docs, tags).collect()} == {1: ["y", "z"], 2: []}
    sources = frame([("m", 2, "c2"), ("m", 1, "c1")], "message_id string, rank int, chunk_id string")
    got = {r.message_id: r.sources and [s.chunk_id for s in r.sources] for r in C.with_sources(frame([("m",), ("n",)], "message_id string"), sources, "chunk_id").collect()}
    assert got == {"m": ["c1", "c2"], "n": None}
    assert {r.query_id: r.ms for r in C.with_latency(frame([("q",), ("r",)], "query_id string"), frame([("q", 7)], "query_id string, ms int")).collect()} == {"q": 7, "r": None}


def test_memories(frame):
    turns = frame([("c", "1", " hi ", "<think>x</think>yes"), ("c", "1", " hi ", "<think>x</think>yes"), ("d", "2", None, "<think>only"), ("d", "3", "p" * 2000, "a" * 4000), ("d", None, "p", "a")], "conversation_id string, message_id string, prompt string, answer string", "id", "text")
    made = C.memories(turns)
    got = {r.id: r.text for r in made.collect()}
    assert got["mem_1"] == "[Past Conversation Context]\nUser: hi\nAssistant: yes" and got["mem_2"].endswith("Assistant: <think>only") and set(got) == {"mem_1", "mem_2", "mem_3"}
    assert len(got["mem_3"]) == len("[Past Conversation Context]\nUser: \nAssistant: ") + 4800
    assert [r.id for r in C.forgotten(made, frame([("d",)], "conversation_id string")).collect()] == ["mem_1"]


def test_records_cases_and_files(spark, frame):
    answers = frame([("a", "q", 1), ("a", "gone", 2), ("b", "q", 1), ("c", None, 1)], "answer_id string, query_id string, created_at int")
    assert {r.answer_id: r.query_id for r in C.answer_records(answers, frame([("q",), ("q",)], "query_id string")).collect()} == {"a": None, "b": "q", "c": None}
    feedback = frame([(1, "why?", None, "7"), (2, "", "better", "8"), (3, None, None, "9"), (4, "why?", None, " ")], "feedback_id int, question string, correction string, expected_doc_id string", "status")
    assert [(r.feedback_id, r.question) for r in C.cases_from_feedback(feedback).orderBy("feedback_id").collect()] == [(1, "why?"), (2, "better")]
    values = spark.createDataFrame([("  up ",), ("",), (None,)], "v string").select(C.feedback_value(F.col("v")).alias("x")).collect()
    assert [r.x for r in values] == ["up", "unknown", "unknown"]
    docs = frame([(1, "/a", 5, 10, "h"), (2, "/b", 5, 10, "h"), (3, "/c", 5, 10, "h"), (4, "/d", 5, 10, "h"), (5, "/e", None, None, "h")], "doc_id int, path string, size bigint, modified_at int, content_hash string")
    files = frame([("/a", 5, 10, "other"), ("/b", 6, 10, "other"), ("/c", 6, 10, "h"), ("/e", 5, 10, "i")], "path string, length bigint, modified_at int, content_hash string")
    assert {r.doc_id: r.reasons for r in C.stale_files(docs, files).collect()} == {2: ["content_changed"], 4: ["file_missing"], 5: ["content_changed"]}
    assert C.config_hash("p", {"b": 1, "a": 2}) == C.config_hash("p", {"a": 2, "b": 1}) != C.config_hash("q", {"a": 2, "b": 1})
    states = spark.createDataFrame([(None,), ("x" * 80,)], "e string").select(C.status_after(F.col("e")).alias("s")).collect()
    assert [r.s for r in states] == ["ready", "failed: " + "x" * 50]
