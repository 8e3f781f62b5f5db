"""Most similar vectors for every vector: a forest of random-projection trees behind one shared priority queue.

Trees are grown on a bounded sample: a node splits at the median of the projection on the axis between two running
means that random vectors pull apart. Every vector goes to its leaf in each tree. A query opens leaves of all trees
through one queue, nearest split first, until it has opened so many. The queue is worked off level by level for a
batch at once: of each level the nodes stay that the queue would pop first, which gives the leaves it would open.

Leaves that hang together form a cell, the part of a tree that one task holds. A vector goes once to each cell in which
it is at home or opens leaves, so what is shuffled is some vectors' copies, not one for each leaf. Within a cell the
leaves are compared in blocks of matrix products: first everyone's own leaf, which says what is worth keeping, then the
others. The best of each cell are reranked exactly, in double precision, before they leave it.

Equal vectors are one class with a representative, so copies neither fill leaves nor cost comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import discard, materialise


@dataclass
class Tree:
    axes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray  # a pair per node; a leaf is -1 - its number
    root: int
    sizes: np.ndarray  # of the sample, by leaf


def grow(sample: np.ndarray, leaf: float, rng: np.random.Generator) -> Tree:
    """A tree of which a leaf holds some leaf vectors of the sample (unit vectors, float32)."""
    axes, cuts, children, sizes = [], [], [], []

    def axis(ix: np.ndarray) -> np.ndarray:
        pulled = rng.choice(ix, min(len(ix), 100), replace=False)
        a, b = sample[pulled[0]].astype(np.float64), sample[pulled[1]].astype(np.float64)
        na = nb = 1
        for v in sample[pulled[2:]]:
            if v @ a * np.linalg.norm(b) > v @ b * np.linalg.norm(a):
                a, na = (a * na + v) / (na + 1), na + 1
            else:
                b, nb = (b * nb + v) / (nb + 1), nb + 1
        out = a / max(np.linalg.norm(a), 1e-12) - b / max(np.linalg.norm(b), 1e-12)
        size = np.linalg.norm(out)
        return (out / size if size > 1e-9 else rng.normal(size=sample.shape[1])).astype(np.float32)

    def split(ix: np.ndarray) -> int:
        if len(ix) > max(leaf, 2):
            for attempt in range(5):  # an axis that parts nothing gives way to random ones
                way = axis(ix) if attempt == 0 else rng.normal(size=sample.shape[1]).astype(np.float32)
                at = sample[ix] @ way
                cut = np.float32(np.median(at))
                left = at < cut
                if left.any() and not left.all():
                    node = len(axes)
                    axes.append(way), cuts.append(cut), children.append((0, 0))
                    children[node] = (split(ix[left]), split(ix[~left]))
                    return node
        sizes.append(len(ix))
        return -len(sizes)

    root = split(np.arange(len(sample)))
    return Tree(np.array(axes, dtype=np.float32).reshape(-1, sample.shape[1]), np.array(cuts, dtype=np.float32), np.array(children, dtype=np.int64).reshape(-1, 2), root, np.array(sizes))


class Forest:
    """All trees in one numbering: nodes from 0, leaves from -1 down; and the cell of each leaf."""

    def __init__(self, trees: list[Tree], most: float):
        """most: vectors of the sample that a cell may hold."""
        node_at = np.cumsum([0, *[len(t.axes) for t in trees]])
        leaf_at = np.cumsum([0, *[len(t.sizes) for t in trees]])
        shift = lambda t, x: np.where(x < 0, x - leaf_at[t], x + node_at[t])
        self.axes, self.cuts = np.concatenate([t.axes for t in trees]), np.concatenate([t.cuts for t in trees])
        self.children = np.concatenate([shift(i, t.children) for i, t in enumerate(trees)])
        self.roots = np.array([int(shift(i, np.array(t.root))) for i, t in enumerate(trees)])
        sizes = np.concatenate([t.sizes for t in trees])
        self.cell = np.zeros(len(sizes), dtype=np.int64)
        self.cells = 0

        def below(node: int) -> list[int]:
            return [-1 - node] if node < 0 else below(int(self.children[node, 0])) + below(int(self.children[node, 1]))

        def deal(node: int) -> None:
            leaves = below(node)
            if node < 0 or sizes[leaves].sum() <= most:
                self.cell[leaves] = self.cells
                self.cells += 1
            else:
                deal(int(self.children[node, 0])), deal(int(self.children[node, 1]))

        for root in self.roots:
            deal(int(root))

    def opened(self, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """leaves (their numbers from 0, or -1) and how far each is, for each vector: its own leaves, which are 0 far, and those that the queue pops next, most in all."""
        n, most = len(vectors), max(most, len(self.roots))
        node = np.broadcast_to(self.roots, (n, len(self.roots))).copy()
        far = np.zeros(node.shape, dtype=np.float32)
        whole = vectors @ self.axes.T if len(self.axes) <= 4096 else None
        while (node >= 0).any():
            inner = node >= 0
            at = np.where(inner, node, 0)
            shift = (np.take_along_axis(whole, at, 1) if whole is not None else np.einsum("nwd,nd->nw", self.axes[at], vectors)) - self.cuts[at]
            right = (shift >= 0).astype(np.int64)
            near = np.where(inner, self.children[at, right], node)
            other = np.where(inner, self.children[at, 1 - right], 0)
            # a queue opens the near side first: of leaves behind one split, those on it are a trifle nearer
            cost = np.where(inner, np.maximum(far * 1.000001, np.maximum(np.abs(shift), 1e-12)), np.inf)
            node, far = np.concatenate([near, other], 1), np.concatenate([far, cost], 1).astype(np.float32)
            if node.shape[1] > most:
                kept = np.argpartition(far, most - 1, axis=1)[:, :most]
                node, far = np.take_along_axis(node, kept, 1), np.take_along_axis(far, kept, 1)
            node = np.where(np.isinf(far), -1, node)
        return np.where(np.isinf(far), -1, -1 - node), far


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _routed(batches: Iterator[pd.DataFrame], forest: Forest, probes: int) -> Iterator[pd.DataFrame]:
    """A row per vector and cell: c, v, home (its own leaf in the cell, or -1) and the leaves that it opens there."""
    for batch in batches:
        for low in range(0, len(batch), 2048):
            part = batch.iloc[low : low + 2048]
            raw = np.stack(part["v"].to_numpy()).astype(np.float32)
            leaves, far = forest.opened(_unit(raw).astype(np.float32), probes)
            asked = part["asked"].to_numpy(dtype=bool)
            keep = (leaves >= 0) & ((far == 0) | asked[:, None])
            row, col = np.nonzero(keep)
            leaf, own = leaves[row, col], far[row, col] == 0
            cell = forest.cell[leaf]
            order = np.lexsort((leaf, cell, row))
            row, leaf, own, cell = row[order], leaf[order].astype(np.int32), own[order], cell[order]
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])
            ends = np.r_[starts[1:], len(row)]
            home = np.maximum.reduceat(np.where(own, leaf, -1), starts)
            data, keys = [x.tobytes() for x in raw], part["c"].to_numpy()
            yield pd.DataFrame({"cell": cell[starts], "c": keys[row[starts]], "v": [data[i] for i in row[starts]], "home": home, "opens": [leaf[s:e].tobytes() if asked[i] else b"" for s, e, i in zip(starts, ends, row[starts], strict=True)]})


def cell_neighbours(rows: pd.DataFrame, k: int, digits: int = 6, block: int = 2048) -> pd.DataFrame:
    """For each query of a cell the k most similar members of the leaves that it opens, exactly; equal ones in the order of their keys."""
    rows = rows.sort_values("c", ignore_index=True)
    unit = _unit(np.frombuffer(b"".join(rows["v"]), dtype=np.float32).reshape(len(rows), -1))
    light, keys, home = unit.astype(np.float32), rows["c"].to_numpy(), rows["home"].to_numpy()
    counts = np.array([len(o) // 4 for o in rows["opens"]])
    leaf, who = np.frombuffer(b"".join(rows["opens"]), dtype=np.int32), np.repeat(np.arange(len(rows)), counts)
    order = np.argsort(leaf, kind="stable")
    leaf, who = leaf[order], who[order]
    members = np.argsort(home, kind="stable")
    floor = np.full(len(rows), -8, dtype=np.float32)
    out_q, out_m, out_s = [], [], []

    def meet(q: np.ndarray, m: np.ndarray, own: bool) -> None:
        for low in range(0, len(q), block):
            part = q[low : low + block]
            rough = light[part] @ light[m].T
            if own:  # a query is not its own neighbour
                rough[np.arange(len(part)), np.searchsorted(m, part)] = -9
            fresh = floor[part] < -7  # nothing yet says what is worth keeping
            if len(m) > k and fresh.any():
                floor[part[fresh]] = np.partition(rough[fresh], -k, axis=1)[:, -k] - 1e-5
            i, j = np.divmod(np.flatnonzero(rough >= floor[part][:, None]), len(m))
            out_q.append(part[i])
            out_m.append(m[j])
            out_s.append(rough[i, j])

    for first in (True, False):
        for name in np.unique(leaf):
            low, high = np.searchsorted(leaf, [name, name + 1])
            m = members[slice(*np.searchsorted(home[members], [name, name + 1]))]
            q = who[low:high]
            q = q[(home[q] == name) == first]
            if len(q) and len(m):
                meet(q, m, first)
    if not out_q:
        return pd.DataFrame({"c": [], "near": [], "to": []})
    q, m, s = np.concatenate(out_q), np.concatenate(out_m), np.concatenate(out_s)

    def places(order: np.ndarray) -> np.ndarray:
        """The place of each row, in that order, within its query."""
        sorted_q = q[order]
        return np.arange(len(q)) - np.searchsorted(sorted_q, sorted_q)

    order = np.lexsort((-s, q))
    place = places(order)
    q, m, s = q[order], m[order], s[order]
    least = np.full(len(rows), -8, dtype=np.float32)
    least[q[place == k - 1]] = s[place == k - 1] - 1e-5
    kept = s >= least[q]
    q, m = q[kept], m[kept]
    exact = np.concatenate([np.einsum("nd,nd->n", unit[q[i : i + 50_000]], unit[m[i : i + 50_000]]) for i in range(0, len(q), 50_000)]).round(digits)
    order = np.lexsort((m, -exact, q))  # rows stand in the order of their keys
    kept = order[places(order) < k]
    q, m, exact = q[kept], m[kept], exact[kept]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    ends = np.r_[starts[1:], len(q)]
    names = keys[m]
    return pd.DataFrame({"c": keys[q[starts]], "near": [-exact[a:b] for a, b in zip(starts, ends, strict=True)], "to": [list(names[a:b]) for a, b in zip(starts, ends, strict=True)]})


def _searched(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows in order of cell: one cell after another."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        while len(batch):
            same = (batch["cell"] == batch["cell"].iloc[0]).to_numpy()
            if held and held[0]["cell"].iloc[0] != batch["cell"].iloc[0]:
                yield cell_neighbours(pd.concat(held, ignore_index=True), k)
                held = []
            held.append(batch[same])
            batch = batch[~same]
    if held:
        yield cell_neighbours(pd.concat(held, ignore_index=True), k)


def nearest(vectors: DataFrame, key: str = "id", vector: str = "vector", k: int = 5, dimension: int = 64, queries: str | None = None, trees: int = 4, leaf: int = 1024, probes: int | None = None, sample: int = 20_000, cell: int = 16_384, seed: int = 7) -> DataFrame:
    """key, neighbours array<struct<similarity, id>>: for every vector the ids of its k most similar others.

    Similarity is the cosine in double precision, rounded to 6 decimals; of equals the smaller id (as text) goes
    first. Only vectors of dimension finite values, not all zero, take part; null ones don't. A repeated id counts
    once, with its smallest vector if they differ, and is never its own neighbour. queries is a condition in SQL on
    the key column, named id, that restricts who asks; all are asked about.

    The trees know at most sample vectors, which bounds the driver's part; every vector is indexed and found. A leaf
    holds about leaf vectors whatever their number, until the sample has fewer than two to a leaf; then leaves grow. A
    cell, which one task holds, has about cell vectors at home. probes is how many leaves a query opens; None opens
    more of them the more there are: for each tree one and the binary logarithm of its leaves. recall against brute
    force is measured in the tests and stated in the README.
    """
    spark = vectors.sparkSession
    usable = f"v is not null and size(v) = {int(dimension)} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    rows = vectors.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null").where(usable)
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    # a class: its vector, its smallest ids (as many as any one of its members or neighbours can need), its smallest id as key
    keyed = materialise(rows.select("id", "v", F.expr(queries or "true").alias("asks"), F.md5(F.to_json("v")).alias("h")), "vectors")
    classes = keyed.groupBy("h").agg(F.min("id").alias("c"), F.first("v").alias("v"), F.max("asks").alias("asked"), F.count("*").alias("n"))
    classes = materialise(classes, "classes")
    few = materialise(_smallest(keyed, classes.where("n > 1"), k + 1), "copies")
    total = classes.count()
    if not total:
        return spark.createDataFrame([], f"{key} string, neighbours array<struct<similarity:double,id:string>>")
    taken = classes.select("c", "v").orderBy(F.xxhash64("c", F.lit(seed)), "c").limit(sample).collect()
    grown = np.array([r.v for r in taken], dtype=np.float64)
    grown = (grown / np.linalg.norm(grown, axis=1, keepdims=True)).astype(np.float32)
    rng = np.random.default_rng(seed)
    scale = len(grown) / total
    forest = Forest([grow(grown, leaf * scale, rng) for _ in range(trees)], cell * scale)
    if probes is None:
        probes = round(trees * (1 + np.log2(max(len(forest.cell) / trees, 1))))
    sent = spark.sparkContext.broadcast(forest)
    routed = classes.select("c", "v", "asked").mapInPandas(lambda b: _routed(b, sent.value, probes), "cell int, c string, v binary, home int, opens binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), forest.cells)
    found = routed.repartition(parts, "cell").sortWithinPartitions("cell").mapInPandas(lambda b: _searched(b, k), "c string, near array<double>, to array<string>")
    both = found.select("c", F.zip_with("near", "to", lambda d, c: F.struct(d.alias("d"), c.alias("c"))).alias("best"))
    best = both.groupBy("c").agg(F.flatten(F.collect_list("best")).alias("all")).select("c", F.slice(F.array_sort(F.array_distinct("all")), 1, k).alias("best"))
    # classes to ids: of a neighbouring class its smallest ids, of the own one too
    near = best.select("c", F.explode("best").alias("b")).select("c", F.col("b.d").alias("d"), F.col("b.c").alias("of"))
    near = near.join(few.select(F.col("c").alias("of"), "ids"), "of", "left").select("c", F.transform(F.coalesce("ids", F.array("of")), lambda x: F.struct(F.col("d").alias("d"), x.alias("id"))).alias("ids"))
    own = few.select("c", F.transform("ids", lambda x: F.struct(F.lit(-1.0).alias("d"), x.alias("id"))).alias("ids"))
    lists = near.union(own).groupBy("c").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    asking = keyed.where("asks").join(classes.select("h", "c"), "h").select("id", "c").join(lists, "c", "left")
    others = F.slice(F.filter(F.coalesce("ids", F.array().cast("array<struct<d:double,id:string>>")), lambda x: x["id"] != F.col("id")), 1, k)
    return asking.select(F.col("id").alias(key), F.transform(others, lambda x: F.struct((-x["d"]).alias("similarity"), x["id"].alias("id"))).alias("neighbours"))


def _smallest(keyed: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """c, ids: the n smallest ids of each class. Each round takes the minimum of what is left, so no class is gathered."""
    left = materialise(keyed.select("id", "h").join(classes.select("h", "c"), "h").select("c", "id"), "copied")
    taken = left.groupBy("c").agg(F.array(F.min("id")).alias("ids"))
    for _ in range(n - 1):
        taken, old = materialise(taken, "taken"), taken
        discard(old)
        more = left.join(taken, "c").where(F.col("id") > F.element_at("ids", -1)).groupBy("c").agg(F.min("id").alias("next"))
        taken = taken.join(more, "c", "left").select("c", F.when(F.col("next").isNull(), F.col("ids")).otherwise(F.concat("ids", F.array("next"))).alias("ids"))
    return taken


def neighbour_pairs(vectors: DataFrame, key: str = "id", **options) -> DataFrame:
    """id_a < id_b: one of the two is among the k most similar of the other."""
    found = nearest(vectors, key, **options).select(F.col(key).alias("x"), F.explode("neighbours.id").alias("y"))
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
