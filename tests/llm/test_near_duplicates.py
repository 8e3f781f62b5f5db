from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm.near_duplicates import components, near_duplicate_groups, near_duplicate_pairs, shingle_set, signatures

ROWS = "key string, text string"


def brute(rows, width, threshold, least):
    sets = {}
    for k, t in rows:
        w = (t or "").lower().split()
        if len(w) >= max(least, width):
            sets[k] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def corpus(seed, groups, copies, edits=4, shortest=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(shortest, 90))
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits) if c else 0):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((f"g{g:03}c{c}", " ".join(words)))
    return rows


def test_pairs_against_brute_force(frame):
    rows = corpus(1, 60, 4) + [("short", "w1 w2"), ("none", None), ("blank", " ")]
    got = {(r.key_a, r.key_b) for r in near_duplicate_pairs(frame(rows + rows[:5], ROWS, "c", "kind", "k"), "key", width=3, threshold=0.6, least_words=20).collect()}
    want = brute(rows, 3, 0.6, 20)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_large_buckets_lose_no_link(frame):
    """A group far above the cap: stars, finer buckets and blocks must still give every pair."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for c in range(60):
        words = list(base)
        words[rng.randrange(80)] = f"x{c}"
        rows.append((f"k{c:02}", " ".join(words)))
    got = {(r.key_a, r.key_b) for r in near_duplicate_pairs(frame(rows, ROWS), "key", width=3, threshold=0.6, cap=4).collect()}
    assert got == brute(rows, 3, 0.6, 1) and len(got) == 60 * 59 / 2


def test_copies_kinds_and_expansion(frame):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(f"k{i}", text) for i in range(6)] + [("z", text.replace("w39", "other"))]
    pairs = near_duplicate_pairs(frame(rows, ROWS), "key", width=3, threshold=0.6).collect()
    assert len(pairs) == 15 + 6
    star = {(r.key_a, r.key_b) for r in near_duplicate_pairs(frame(rows, ROWS), "key", width=3, threshold=0.6, expand_copies=3).collect()}
    assert star == {("k0", f"k{i}") for i in range(1, 6)} | {("k0", "z")}
    kinds = near_duplicate_pairs(frame(rows, ROWS), "key", width=3, threshold=0.6, kind=F.when(F.col("key") < "k3", "a").otherwise("b"))
    assert {(r.kind, r.key_a < "k3") for r in kinds.collect()} == {("a", True), ("b", False)}


def test_groups_and_components(frame, spark):
    rows = corpus(4, 10, 3, 2, 60)
    links, root = brute(rows, 3, 0.6, 1), {k: k for k, _ in rows}
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = near_duplicate_groups(frame(rows, ROWS), "key", width=3, threshold=0.6).collect()
    assert len(got) == 30
    by = {r.key: r.group_id for r in got}
    assert all((by[a] == by[b]) == (root[a] == root[b]) for a in by for b in by)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 300)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert {roots[i] for i in range(41)} == {0} and roots[300] == roots[200] == 100
    assert near_duplicate_groups(frame([], ROWS), "key").count() == 0
    assert near_duplicate_pairs(frame([], ROWS), "key").count() == 0


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**32, 60, dtype=np.uint32))
    b = np.unique(np.concatenate([a[:45], rng.integers(0, 2**32, 15, dtype=np.uint32)]))
    share = np.mean([(s[0] == s[1]).mean() for s in (signatures([a, b], 160, seed) for seed in range(30))])
    assert abs(share - 45 / (len(a) + len(b) - 45)) < 0.05
    assert len(shingle_set(np.arange(2, dtype=np.uint64), 3)) == 0
