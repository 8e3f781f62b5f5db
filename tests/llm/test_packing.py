from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm.packing import Packer, hilbert_keys, pack

FOLDER = "/opt/tokenizers"
needs = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the public tokenizers aren't here")


def test_hilbert_neighbours_are_one_step_apart():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packer_never_overfills():
    rng, packer, done = random.Random(1), Packer(100, 4), []
    for i in range(500):
        full = packer.put(rng.randint(0, 100), i)
        done += [full] if full else []
    assert sum(map(len, done)) + sum(len(items) for _, items in packer.rest()) == 500
    assert all(used <= 100 for used, _ in packer.rest())


@needs
def test_every_text_once_whole_and_tight(frame):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(1, 60)))) for i in range(600)]
    texts += [(600, "word " * 500), (601, ""), (602, None), (1, texts[1][1])]
    got = pack(frame(texts, "doc_id bigint, text string", "k", "used", "piece"), 128).collect()
    by, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        by[r.container] += r.n_tokens
        pieces[r.doc_id].append((r.start, r.n_tokens))
        assert r.used <= 128
    assert all(by[r.container] == r.used for r in got)
    assert set(pieces) == set(range(602))
    assert all(len(p) == 1 for d, p in pieces.items() if d != 600)
    at = 0
    for start, n in sorted(pieces[600]):
        assert start == at
        at += n
    assert sum(by.values()) / (128 * len(by)) > 0.95


@needs
def test_empty_table_and_copies(frame):
    assert pack(frame([], "doc_id bigint, text string"), 128).count() == 0
    got = pack(frame([(i, "same words here") for i in range(400)], "doc_id bigint, text string"), 64)
    assert got.count() == 400
    with pytest.raises(ValueError):
        pack(frame([], "doc_id bigint, text string"), 0)
