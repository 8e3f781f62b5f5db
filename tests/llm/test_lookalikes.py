from __future__ import annotations

from tessella.llm.lookalikes import consistent_forms, form_classes, plain_form, same_looking_pairs

ROWS = "id string, text string"
ROWS_B = "block_id string, text string"


def test_plain_form():
    assert plain_form("ﬁne ｗｉｄｅ​  é‑x") == "fine wide é-x"
    assert plain_form("x² ½ ① – ’") == "x² ½ ① – ’"  # visible differences stay


def test_pairs_that_look_the_same(frame):
    clean = "the quick valve at Vélgar was open"
    chunks = [("a", clean), ("b", "Привет мир"), ("c", "The quick valve at Vélgar was open"), ("d", "the quick valve at Velgar was open"), ("e", "two 22"), ("f", None), ("g", "")]
    blocks = [("1", "thе quісk valve at Vélgar wаs open"), ("2", "При​вет　мир"), ("3", clean), ("4", "two ２２"), ("5", "two 23"), ("6", None)]
    got = {(r.id, r.block_id) for r in same_looking_pairs(frame(chunks + chunks[:2], ROWS, "k", "raw", "form"), frame(blocks, ROWS_B), "id", "block_id").collect()}
    assert got == {("a", "1"), ("b", "2"), ("e", "4")}


def test_letters_are_right_in_their_own_script(frame):
    rows = [("1", "По данным станции а мы о том"), ("2", "a cat and thе cat sat, the end"), ("3", "а cat in the hat"), ("4", "ѕоmе unknown wоrd")]
    got = {r.id: r.form for r in consistent_forms(frame(rows, ROWS), "id").collect()}
    assert got["1"] == rows[0][1]
    assert got["2"] == "a cat and the cat sat, the end"
    assert got["3"] == "a cat in the hat"
    assert "wоrd" in got["4"]  # no text has the word: it stays as it is


def test_words_of_another_script_stay_where_the_corpus_has_them(frame):
    rows = [("1", "сор в углу и вода"), ("2", "he wrote сор in the cop file"), ("3", "the іѕ file is here"), ("4", "cop file")]
    got = {r.id: r.form for r in consistent_forms(frame(rows, ROWS), "id").collect()}
    assert got["2"] == rows[1][1]  # a Russian word, though "cop" is one too
    assert got["3"] == "the is file is here"


def test_classes(frame):
    rows = [("a", "same text"), ("b", "same text"), ("c", "sаme text"), ("d", "other"), ("e", None), ("a", "same text")]
    got = {r.id: (r.n_rows, r.n_texts) for r in form_classes(frame(rows, ROWS, "k", "form"), "id").collect()}
    assert got == {"a": (3, 2), "b": (3, 2), "c": (3, 2), "d": (1, 1)}
    assert form_classes(frame([], ROWS), "id").count() == 0


def test_empty_tables_and_hot_copies(frame):
    assert same_looking_pairs(frame([], ROWS), frame([], ROWS_B), "id", "block_id").count() == 0
    chunks, blocks = [(f"c{i}", "same text") for i in range(300)], [(f"b{i}", "same text") for i in range(300)] + [("odd", "same text")]
    got = same_looking_pairs(frame(chunks, ROWS), frame(blocks, ROWS_B), "id", "block_id").collect()
    assert len(got) == 300 and {r.block_id for r in got} == {"odd"}
