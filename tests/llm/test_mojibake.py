from __future__ import annotations

import random

import pytest

from tessella.llm.mojibake import repair_encoding

CLEAN = ["Das Gerät für den Prüfbericht wäre größer, sagt Herr Müller über die Öffnung.", "Le contrôle était déjà fermé après l’été, où le relevé précédait.", "По данным станции фильтр уже превысил этот новый предел.", "Każdy łącznik opóźnił swój wąwóz, źródło było też żółte.", "Ça coûte 3 € à Noël.", "plain ascii only", "NÃO É ASSIM, A AVALIAÇÃO.", "ПО ДАННЫМ СТАНЦИИ"]


def garble(text, write, read, lossy="strict"):
    return text.encode(write).decode(read, lossy)


def fixed(frame, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(CLEAN * 60)]
    got = {r.doc_id: r for r in repair_encoding(frame(rows, "doc_id bigint, text string", "steps", "k", "garbled")).collect()}
    assert not any(r.garbled for i, r in got.items() if i >= 1000), [r for i, r in got.items() if i >= 1000 and r.garbled][:2]
    assert all(got[1000 + i].restored == t for i, t in enumerate(CLEAN))
    return got


@pytest.mark.parametrize(("write", "read"), [("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1250")])
def test_utf8_read_otherwise(frame, write, read):
    texts = [garble(t, write, read) for t in CLEAN[:2]]
    got = fixed(frame, texts)
    assert [got[i].restored for i in range(2)] == CLEAN[:2]


def test_twice_cyrillic_partial_and_references(frame):
    twice = garble(garble(CLEAN[0], "utf-8", "latin-1"), "utf-8", "latin-1")
    part = CLEAN[1] + "\n" + garble(CLEAN[0], "utf-8", "latin-1")
    texts = [twice, garble(CLEAN[2], "cp1251", "latin-1"), garble(CLEAN[2], "koi8_r", "cp1251"), part, "caf&eacute; &amp; th&eacute;"]
    got = fixed(frame, texts)
    assert got[0].restored == CLEAN[0]
    assert got[1].restored == CLEAN[2]
    assert got[2].restored == CLEAN[2]
    assert got[3].restored == CLEAN[1] + "\n" + CLEAN[0]
    assert got[4].restored == "café & thé"


def test_lost_characters_nulls_and_empties(frame):
    got = fixed(frame, [garble("für Öl", "latin-1", "utf-8", "replace"), None, "", " "])
    assert got[0].lost and got[0].garbled and not got[1].garbled and got[1].restored is None and got[2].restored == "" and got[3].restored == " "
    empty = frame([], "doc_id bigint, text string")
    assert repair_encoding(empty).count() == 0
    only = repair_encoding(frame([(1, garble(CLEAN[0], "utf-8", "latin-1")), (2, "fine")], "doc_id bigint, text string"), garbled_only=True)
    assert [r.doc_id for r in only.collect()] == [1]


def test_copies_of_a_garbled_text_stay_garbled(frame):
    """A garbled text in a third of the rows, alone or as a part of others, and another one garbled the same way."""
    rng = random.Random(3)
    words = "данным станции фильтр превысил предел новый насос держал давление отчёт журнал канал берег сухой вечер группа проверила каждый датчик около моста письмо".split()
    clean = [f"По {' '.join(rng.choices(words, k=9))}." for _ in range(400)]
    first, second = "Вечер группа проверила новый журнал около моста.", "Каждый датчик держал давление."
    bad = [garble(t, "cp1251", "latin-1") for t in (first, second)]
    rows = [*clean, *[bad[0]] * 150, *[f"note {i}\n{bad[0]}" for i in range(50)], bad[1]]
    got = {r.doc_id: r for r in repair_encoding(frame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert all(got[i].restored == t and not got[i].garbled for i, t in enumerate(clean))
    assert {got[i].restored for i in range(400, 550)} == {first} and got[600].restored == second
    assert all(got[550 + i].restored == f"note {i}\n{first}" for i in range(50))
