from __future__ import annotations

import random

from tessella.llm.leakage import leaked_passages

DOCS, ITEMS = "doc_id bigint, text string", "item_id string, passage string"


def brute(docs, items, n):
    out = set()
    for i, p in items:
        grams = {tuple(p.split()[k : k + n]) for k in range(len(p.split()) - n + 1)} if p else set()
        for d, t in docs:
            words = t.split() if t else []
            if any(tuple(words[k : k + n]) in grams for k in range(len(words) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force_in_many_shards_and_blocks(frame):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.randint(3, 40)))) for k in range(12)]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if d % 3 == 0:
            source = rng.choice(items)[1].split()
            at, n = rng.randrange(len(source)), rng.randint(4, 20)
            words[len(words) // 2 : len(words) // 2] = source[at : at + n]
        docs.append((d, " ".join(words)))
    want = brute(docs, items, 6)
    for options in ({}, {"shard_words": 50}, {"block_words": 20}):
        got = leaked_passages(frame(docs, DOCS, "k", "i", "kind"), frame(items, ITEMS, "text"), min_words=6, **options)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_places_lengths_and_proximity(frame):
    docs = [(1, "x y Alpha, beta gamma delta epsilon zeta z"), (2, "alpha beta very gamma delta epsilon zeta"), (3, "zeta epsilon delta gamma beta alpha")]
    items = [("i", "lead alpha beta gamma delta epsilon zeta tail")]
    [hit] = leaked_passages(frame(docs, DOCS), frame(items, ITEMS), min_words=6).collect()
    assert (hit.doc_id, hit.kind, hit.doc_word, hit.item_word, hit.n_words) == (1, "phrase", 2, 1, 6)
    near = {r.doc_id for r in leaked_passages(frame(docs, DOCS), frame(items, ITEMS), min_words=6, slop=2, share=0.8).collect() if r.kind == "proximity"}
    assert near == {1, 2}


def test_nulls_empties_repeats(frame):
    docs = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "a b c")]
    items = [("n", None), ("e", ""), ("s", "a b"), ("i", "a b c d")]
    got = leaked_passages(frame(docs, DOCS), frame(items, ITEMS), min_words=4).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(3, "i"), (3, "i")]
    assert leaked_passages(frame([], DOCS), frame(items, ITEMS), min_words=4).count() == 0
    assert leaked_passages(frame(docs, DOCS), frame([], ITEMS), min_words=4).count() == 0


def test_proximity_tries_every_window(frame):
    """A changed run of 12 words anywhere in 17."""
    words = [f"w{i}" for i in range(17)]
    docs = [(b, " ".join(["x", *words[b : b + 6], "other", *words[b + 7 : b + 12], "y"])) for b in range(6)]
    hits = leaked_passages(frame(docs, DOCS), frame([("i", " ".join(words))], ITEMS), slop=1, share=0.9).collect()
    assert {r.doc_id for r in hits if r.kind == "proximity"} == set(range(6))
    assert {(r.doc_id, r.item_word) for r in hits} >= {(b, b) for b in range(6)}
