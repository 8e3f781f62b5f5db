from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import catalogue


def test_routes(spark):
    rows = [("Hello!", None), ("translate this sentence for me please now", None), ("What does the report say?", "auto"), ("short words", None), ("why is it so that rivers carry stone", None), ("anything", "high"), ("the file", "off")]
    df = spark.createDataFrame(rows, "p string, s string")
    assert [r.x for r in df.select(catalogue.retrieval_route(F.col("p"), F.col("s")).alias("x")).collect()] == ["off", "off", "medium", "off", "medium", "high", "off"]
    assert df.select(catalogue.retrieval_route(F.lit("hi"), F.lit(None).cast("string"), True).alias("x")).first().x == "medium"


def test_unit_answers_and_payloads(frame):
    got = {r.query_id: r.answer for r in catalogue.unit_answers(frame([("a", 1, "S1", "5"), ("a", 2, "S2", "5"), ("b", 1, "S1", "5"), ("b", 2, "S2", "6 ± 1")], "query_id string, place int, source_id string, value string")).collect()}
    assert got["a"] == "The document states **5** [[src:S1]]." and "- **6 ± 1** [[src:S2]]" in got["b"]
    docs = frame([(1, None, "/x/name.pdf"), (2, "Two", None)], "doc_id bigint, display_name string, path string")
    chunks = frame([("c1", 1, 1, "x" * 600), ("c0", 1, 0, None)], "id string, doc_id bigint, chunk_index bigint, text string")
    rows = {r.doc_id: r for r in catalogue.document_payloads(docs, chunks).collect()}
    assert rows[1].name == "name.pdf" and [p.id for p in rows[1].preview] == ["c0", "c1"] and len(rows[1].preview[1].text) == 500
    assert rows[2].n_chunks == 0 and rows[2].preview is None


def test_written_stages_can_be_discarded(spark):
    from tessella.session import discard, materialise

    first = materialise(spark.range(5), "first")
    second = materialise(first.where("id > 1"), "second")
    discard(first, spark.range(3))
    assert second.count() == 3
    path = first._stage.removeprefix("file://")
    import os

    assert not os.path.exists(path) and os.path.exists(second._stage.removeprefix("file://"))
