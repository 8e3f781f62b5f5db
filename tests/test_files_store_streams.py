from __future__ import annotations

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.operators import chunking, layout
from tessella.sources import files
from tessella.store import Store, violations
from tessella.streaming import events


def xlsx(rows, style=None):
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r}" s="1"><v>{v}</v></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><numFmts><numFmt numFmtId="170" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_discovery_and_extraction(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.txt").write_text("no")
    (tmp_path / "a.txt").write_bytes("für Öl".encode("latin-1"))
    (tmp_path / "b.csv").write_text("n;m\n1;2\n3;4\n")
    (tmp_path / "c.xlsx").write_bytes(xlsx([["Name", "Rate"], ["alpha", 0.125]]))
    (tmp_path / "d.bin").write_bytes(b"\0\1\2")
    (tmp_path / "e.html").write_text("<p>one &amp; two</p><script>x</script>three")
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip")
    got = {r.path.split("/")[-1]: r for r in files.extract(files.discover(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.txt", "b.csv", "c.xlsx", "e.html", "broken.xlsx"}
    assert got["a.txt"].text == "für Öl" and got["e.html"].text == "one & two\nthree"
    assert got["b.csv"].tables[0].rows == [["n", "m"], ["1", "2"], ["3", "4"]]
    assert got["c.xlsx"].tables[0].rows == [["Name", "Rate"], ["alpha", "12.5%"]] and got["c.xlsx"].tables[0].sheet_name == "S"
    assert got["broken.xlsx"].error.startswith("failed")


def test_store_commits_rolls_back_and_migrates(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    docs = lambda *ids: spark.createDataFrame([(i, f"v{v}") for i, v in ids], "doc_id bigint, v string")
    store.commit({"documents": docs((1, 1), (2, 1)), "chunks": docs((1, 1), (1, 1), (2, 1))})
    store.replace_documents({"documents": docs((2, 2)), "chunks": docs((2, 2), (2, 3))})
    assert sorted(r.v for r in store.read("chunks").where("doc_id = 2").collect()) == ["v2", "v3"] and store.read("chunks").count() == 4
    store.upsert("documents", docs((2, 9), (3, 1)), "doc_id")
    assert {r.doc_id: r.v for r in store.read("documents").collect()} == {1: "v1", 2: "v9", 3: "v1"}
    store.rollback()
    assert {r.doc_id: r.v for r in store.read("documents").collect()} == {1: "v1", 2: "v2"}
    store.insert_new("documents", docs((1, 5), (4, 1)), "doc_id")
    assert {r.doc_id: r.v for r in store.read("documents").collect()} == {1: "v1", 2: "v2", 4: "v1"}
    store.delete_documents(docs((1, 0)))
    assert store.read("documents").where("doc_id = 1").count() == store.read("chunks").where("doc_id = 1").count() == 0
    steps = [lambda s: {"documents": s.read("documents").withColumn("w", F.lit(1))}]
    assert store.migrate(steps) == 1 and store.migrate(steps) == 1 and "w" in store.read("documents").columns
    bad = spark.createDataFrame([(1, "ready"), (1, "odd")], "id bigint, status string")
    assert {r.rule: r.n for r in violations(bad, ("id",), {"status": ("ready",)}).collect()} == {"unique(id)": 1, "allowed(status)": 1}
    with pytest.raises(KeyError):
        store.read("none")


def test_a_failed_write_leaves_the_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"t": spark.range(3)})
    with pytest.raises(Exception):
        store.commit({"t": spark.range(3).select(F.raise_error(F.lit("stop")).cast("bigint").alias("id"))})
    assert store.read("t").count() == 3 and store.manifest()["version"] == 1


def test_streams(spark, tmp_path):
    src = tmp_path / "actions"
    spark.createDataFrame([(1, 1, "start"), (1, 2, "succeed"), (2, 1, "succeed"), (3, 1, "start"), (3, 2, "fail"), (3, 3, "retry")], "job_id bigint, seq bigint, action string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("job_id bigint, seq bigint, action string").parquet(str(src))
    got = {r.job_id: (r.status, r.moves) for r in events.run_available(events.job_states(stream), "jobs", "update").collect()}
    assert got == {1: ("succeeded", 2), 2: ("queued", 0), 3: ("queued", 3)}
    src = tmp_path / "pieces"
    spark.createDataFrame([(1, 1, "a<thi"), (1, 2, "nk>x</th"), (1, 3, "ink>b")], "stream_id bigint, seq bigint, piece string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("stream_id bigint, seq bigint, piece string").parquet(str(src))
    assert [r.text for r in events.run_available(events.visible_pieces(stream), "pieces").collect()] == ["ab"]


@pytest.mark.parametrize("cut", range(1, 20))
def test_hidden_text_however_it_is_cut(cut):
    text, reader = "one <think>two</think> three < four", events.VisibleText()
    got = "".join(reader.feed(text[i : i + cut]) for i in range(0, len(text), cut)) + reader.finish()
    assert got == "one  three < four"


def test_pages_to_blocks(frame):
    words, page = [], lambda p, y, texts, size=10.0, x=60.0: [(1, p, t, x + 60 * i, y, x + 60 * i + 50, y + size, size, "Regular") for i, t in enumerate(texts)]
    for p in (1, 2):
        words += page(p, 20.0, ["Deep", "log"]) + page(p, 400.0, ["body", "text", "exam-"]) + page(p, 411.0, ["ple", "ends", "here."]) + page(p, 780.0, [str(p)])
    words += page(1, 300.0, ["Big", "heading"], 16.0)
    words += [(1, 1, t, x, y, x + 20, y + 10, 10.0, "Regular") for y in (500.0, 512.0) for t, x in (("k", 60.0), ("v", 200.0))]
    lines = layout.page_lines(frame(words, "doc_id bigint, page bigint, text string, x0 double, top double, x1 double, bottom double, size double, fontname string"))
    table = layout.borderless_tables(lines).where("page = 1 and size(rows[0]) = 2").first()
    assert table.rows == [["k", "v"], ["k", "v"]]
    heights = frame([(1, 1, 800.0), (1, 2, 800.0)], "doc_id bigint, page bigint, height double")
    marked = layout.marginal_lines(lines, heights)
    assert {r.text for r in marked.where("repeated").collect()} == {"Deep log", "1", "2"}
    body = marked.where("not repeated and size(cells) = 1").join(layout.body_size(lines), "doc_id")
    kinds = body.withColumn("type", layout.line_type(F.col("text"), F.col("size"), F.col("body_size"), F.col("bold"), F.col("page"), F.col("line_no"))).withColumn("level", layout.heading_level(F.col("size"), F.col("body_size"), F.col("text")))
    ordered = layout.reading_order(kinds, frame([(1, 1, 600.0), (1, 2, 600.0)], "doc_id bigint, page bigint, width double"))
    blocks = layout.heading_paths(layout.blocks(ordered)).orderBy("block_index").collect()
    assert [(b.block_type, b.text) for b in blocks] == [("heading", "Big heading"), ("paragraph", "body text example ends here."), ("paragraph", "body text example ends here.")]
    assert blocks[2].heading_path == ["Big heading"]
    boxes = frame([(1, 1, 0.0, 490.0, 600.0, 530.0)], "doc_id bigint, page bigint, x0 double, top double, x1 double, bottom double")
    assert layout.outside_boxes(lines, boxes).where("page = 1").count() == lines.where("page = 1").count() - 2


def test_structured_chunks_and_summaries(frame):
    rows = [(1, 0, "heading", "Intro", ["Intro"], 1, None), (1, 1, "paragraph", "w " * 100, ["Intro"], 1, [0.0, 0.0, 1.0, 1.0]), (1, 2, "table", "h1 h2\n" + "\n".join(f"a{i} b{i}" for i in range(120)), ["Intro"], 1, None), (1, 3, "footer", "Page 1", [], 1, None), (1, 4, "paragraph", "x " * 400, ["Next"], 2, None), (2, 0, "paragraph", None, None, None, None)]
    got = chunking.structured_chunks(frame(rows + rows[:1], "doc_id bigint, block_index bigint, block_type string, text string, heading_path array<string>, page_number bigint, bounding_box array<double>", "parent_no")).orderBy("child_no").collect()
    assert [r.block_type for r in got] == ["paragraph", "table", "table", "paragraph", "paragraph", "paragraph"] and all(len(r.text.split()) <= 150 for r in got)
    assert all(r.text.startswith("h1 h2") for r in got if r.block_type == "table") and [r.table_part for r in got if r.table_part] == ["1/2", "2/2"]
    text = "We define flow as a rate. We found that the rate improved by 12 % in Alpha Basin. However the trial was short. " * 6
    texts = frame([(text, ["Part One"]), ("", None), ("One unit only", None), (None, None), ("One unit only", ["", " A  b "])], "t string, h array<string>")
    made = [r.s for r in texts.select(chunking.summary(F.col("t"), F.col("h")).alias("s")).collect()]
    assert len(made[0]) <= 700 and made[0].startswith("Section: Part One Entities: We; Alpha Basin; However Values: 12 % Result: We found") and "Limitation: However" in made[0]
    assert made[1:] == ["", "One unit only", None, "Section: A b Entities: One Context: One unit only"]


def test_visible_texts_of_a_folder_of_parts(spark, tmp_path):
    from tessella.queries_documents import visible_texts

    rows = [("a", "one text of some length"), ("a", "one text of some length"), ("a", "another text of a"), ("b", "ends in p < 4"), ("c", ""), (None, "without an id"), ("d", "has <think>x</think>"), ("e", None)]
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = sorted(((i or "", digest(t)) for i, t in {r for r in rows if r[1] is not None and "<think" not in r[1]}))
    df = spark.createDataFrame(rows, "id string, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/parts/chunks.parquet")
    df.toPandas().to_parquet(f"{tmp_path}/chunks.parquet")
    for d in (f"{tmp_path}/parts", str(tmp_path)):
        assert sorted((r.stream_id or "", r.digest) for r in visible_texts(spark, d).collect()) == want
    spark.createDataFrame([], "id string, text string").write.parquet(f"{tmp_path}/none/chunks.parquet")
    assert visible_texts(spark, f"{tmp_path}/none").collect() == []
    (tmp_path / "empty").mkdir()
    assert events.run_available(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/empty"), "nothing").collect() == []
