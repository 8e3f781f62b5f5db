from __future__ import annotations

import heapq

import numpy as np

from tessella.llm.neighbours import Forest, grow, nearest, neighbour_pairs

ROWS = "id string, vector array<float>"


def brute(ids, x, k):
    u = x.astype(np.float64)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    return {ids[i]: [ids[j] for j in sorted(range(len(ids)), key=lambda j, i=i: (-s[i, j], ids[j]))[:k] if j != i] for i in range(len(ids))}


def test_recall_with_small_leaves(frame):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 64))
    x = (centres[rng.integers(0, 30, 3000) ** 2 % 30] + 0.6 * rng.normal(size=(3000, 64))).astype(np.float32)
    ids = [f"v{i:05}" for i in range(len(x))]
    want = brute(ids, x, 5)
    got = {r.id: [n.id for n in r.neighbours] for r in nearest(frame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], ROWS), leaf=128, probes=32, sample=1000, cell=400).collect()}
    hits = sum(len(set(got[i]) & set(want[i])) for i in ids)
    assert hits / (5 * len(ids)) >= 0.9


def test_leaves_are_those_that_one_queue_opens():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64)).astype(np.float32)
    forest = Forest([grow(x, 16, rng) for _ in range(3)], 100)
    leaves, far = forest.opened(x[:40], 12)
    for i in range(40):
        queue, out = [(0.0, int(r)) for r in forest.roots], []
        while len(out) < 12:
            d, node = heapq.heappop(queue)
            while node >= 0:
                shift = float(x[i] @ forest.axes[node]) - float(forest.cuts[node])
                side = int(shift >= 0)
                heapq.heappush(queue, (max(d * 1.000001, abs(shift)), int(forest.children[node, 1 - side])))
                node = int(forest.children[node, side])
            out.append((d, -1 - node))
        assert np.allclose(sorted(d for d, _ in out), np.sort(far[i]), atol=1e-5) and {n for d, n in out if d == 0} >= set(leaves[i][far[i] == 0])
        assert len({n for _, n in out} - set(leaves[i])) <= 1  # a tie at the end of the queue
    assert forest.cells >= 3 * 5 and len(set(forest.cell)) == forest.cells


def test_cells_and_probes_that_reach_everything_are_exact(frame):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 64)).astype(np.float32)
    ids = [f"v{i:03}" for i in range(600)]
    got = {r.id: [n.id for n in r.neighbours] for r in nearest(frame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], ROWS), leaf=50, cell=120, probes=1000).collect()}
    assert got == brute(ids, x, 5)


def test_exact_on_one_leaf_with_ties_copies_and_lengths(frame):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 64)).astype(np.float32)
    x[5:12] = x[4]  # copies: more than k + 1
    x[20] = x[21] * 3  # one direction, two lengths
    ids = [f"v{i:02}" for i in range(40)]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = {r.id: [n.id for n in r.neighbours] for r in nearest(frame(rows + rows[:3], ROWS, "c", "h", "v", "asks")).collect()}
    assert got == brute(ids, x, 5)
    pairs = {(r.id_a, r.id_b) for r in neighbour_pairs(frame(rows, ROWS)).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, bs in got.items() for b in bs}


def test_unusable_vectors_and_empty_tables(frame):
    good = [1.0] + [0.0] * 63
    rows = [("a", good), ("b", [0.5] * 64), ("zero", [0.0] * 64), ("short", [1.0] * 48), ("nan", [float("nan")] + good[1:]), ("inf", [float("inf")] + good[1:]), ("none", None), (None, good)]
    got = {r.id: [n.id for n in r.neighbours] for r in nearest(frame(rows, ROWS)).collect()}
    assert got == {"a": ["b"], "b": ["a"]}
    assert nearest(frame([], ROWS)).count() == 0
    assert {r.id for r in nearest(frame(rows, ROWS), queries="id = 'a'").collect()} == {"a"}
