"""Near-duplicate records: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A text is the set of its distinct runs of successive words. One permutation deals a set into bins and keeps the least
value of each; an empty bin borrows from a bin that a hash of its own number and the attempt chooses, so that equal
sets have equal signatures and bins agree as often as the sets do. Bands of bins are buckets.

- Texts of one set are one class, and only classes meet in buckets: exact copies cost nothing there.
- A bucket of few classes gives all its pairs, at most cap - 1 a class. A larger one gives a star, an edge from each
  class to one centre, and its classes go on to finer buckets by further bins, until they are few. What stays together
  through all levels agrees in so many bins that its pairs are, but for chance, results; they are then listed by
  blocks spread over the cluster. So candidates stay in proportion to rows and results, and no link is dropped.
- A bucket that is large within one task already is salted by task before the shuffle; only its centre meets the others.
- Every candidate is verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import mix, words
from tessella.session import discard, materialise

#: Bits of a bucket's key. Chance meetings of keys only add candidates, which verification drops.
KEY = np.uint64((1 << 48) - 1)
#: Band keys that a task sorts into buckets, some 10 MB.
KEYS_A_TASK = 400_000
#: Need not be more than this for a broadcast: 8 bytes each, some 10 MB with the hash table.
BROADCAST_ROWS = 200_000
EDGE = "a bigint, b bigint, bucket bigint"


class WordHashes:
    """64-bit hashes of words, kept for words met before; forgotten when there are many."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, terms: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in terms:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct 32-bit hashes of runs of width words, sorted."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def signatures(sets: list[np.ndarray], bins: int, seed: int) -> np.ndarray:
    """A row of bins values per set, all of them filled unless the set is empty."""
    lengths = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets), dtype=np.int64), lengths)
    h = mix(np.concatenate(sets).astype(np.uint64) + np.uint64(seed * 0x517CC1B727220A95 % 2**64)) if len(row) else np.zeros(0, np.uint64)
    place = row * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    value = h & np.uint64(0xFFFFFFFF)
    order = np.argsort(place, kind="stable")
    at, starts = np.unique(place[order], return_index=True)
    empty = np.uint64(1 << 33)
    flat = np.full(len(sets) * bins, empty, dtype=np.uint64)
    if len(at):
        flat[at] = np.minimum.reduceat(value[order], starts)
    table = flat.reshape(len(sets), bins)
    filled = table != empty
    rows, cols = np.nonzero(~filled & (lengths > 0)[:, None])
    out, attempt = table.copy(), 0
    while len(rows):
        attempt += 1
        lender = (mix((np.arange(bins, dtype=np.uint64) << np.uint64(20)) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)[cols]
        found = filled[rows, lender]
        out[rows[found], cols[found]] = table[rows[found], lender[found]]
        rows, cols = rows[~found], cols[~found]
    return out


def band_keys(sets: list[np.ndarray], bands: int, width: int, seed: int) -> np.ndarray:
    """A row of bands keys per set."""
    table = signatures(sets, bands * width, seed).reshape(len(sets), bands, width)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(seed << 16), (len(sets), bands)).copy()
    for i in range(width):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, :, i])
    return key & KEY


def _sets(batches: Iterator[pd.DataFrame], width: int, least_words: int) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        out = []
        for kind, key, text in zip(batch["kind"], batch["k"], batch["text"], strict=True):
            terms = words(text)
            if len(terms) >= max(least_words, width):
                data = shingle_set(hashes(terms), width).tobytes()
                out.append((kind, key, xxhash.xxh64_intdigest(data, seed=xxhash.xxh32_intdigest(kind)) - (1 << 63), data))
        if out:
            yield pd.DataFrame(out, columns=["kind", "k", "c", "s"])


def _banded(batches: Iterator[pd.DataFrame], bands: int, width: int, seed: int, cap: int) -> Iterator[pd.DataFrame]:
    """Rows (bucket, salt, hot, c). Input: c, s, and the bucket above, at first a hash of the kind, so that kinds don't meet."""
    from pyspark import TaskContext

    task, turn = TaskContext.get().partitionId(), 0
    for batch in batches:
        batch = batch.drop_duplicates(["c", "up"])
        if not len(batch):
            continue
        turn += 1
        keys = band_keys([np.frombuffer(s, dtype=np.uint32) for s in batch["s"]], bands, width, seed)
        above = batch["up"].to_numpy(dtype=np.int64).astype(np.uint64)
        keys = mix(keys + mix(above)[:, None]) & KEY
        flat, c = keys.ravel().astype(np.int64), np.repeat(batch["c"].to_numpy(dtype=np.int64), bands)
        order = np.lexsort((c, flat))
        flat, c = flat[order], c[order]
        _, starts, counts = np.unique(flat, return_index=True, return_counts=True)
        large = np.repeat(counts > cap, counts)
        salt = np.where(large, task * 100_003 + turn, 0)
        first = np.zeros(len(flat), dtype=bool)
        first[starts] = True
        yield pd.DataFrame({"bucket": flat, "salt": salt, "hot": large, "c": c})
        if large.any():
            met = large & first
            yield pd.DataFrame({"bucket": flat[met], "salt": 0, "hot": True, "c": c[met]})


def _edges(batches: Iterator[pd.DataFrame], cap: int) -> Iterator[pd.DataFrame]:
    """Buckets in order of (bucket, salt, c) to edges (a, b, null), and to the classes of large ones (c, null, bucket)."""
    carry: pd.DataFrame | None = None
    centre: tuple[int, int, int] | None = None  # bucket, salt and centre of a large bucket under way

    def work(rows: pd.DataFrame, closed: bool) -> Iterator[pd.DataFrame]:
        nonlocal centre
        b, salt, hot, c = (rows[x].to_numpy() for x in ("bucket", "salt", "hot", "c"))
        new = np.r_[True, (b[1:] != b[:-1]) | (salt[1:] != salt[:-1])] if len(b) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(b)])
        out_a, out_b, out_up = [], [], []
        two = starts[(sizes == 2)]
        two = two[~hot[two] & ~hot[two + 1] & (c[two] != c[two + 1])]
        if centre is not None and len(two) and two[0] == 0 and centre[:2] == (b[0], salt[0]):
            two = two[1:]
        out_a.append(c[two])
        out_b.append(c[two + 1])
        out_up.append(np.full(len(two), -1))
        for s, n in zip(starts, sizes, strict=True):
            going = centre is not None and centre[:2] == (b[s], salt[s])
            if n == 2 and not going and not hot[s : s + 2].any() or n == 1 and not going and not hot[s]:
                continue
            own = np.unique(c[s : s + n])
            if going or len(own) > cap or hot[s : s + n].any() or (not closed and s == starts[-1]):
                middle = centre[2] if going else own[0]
                centre = (int(b[s]), int(salt[s]), int(middle))
                spokes = own[own != middle]
                out_a += [np.full(len(spokes), middle), own]
                out_b += [spokes, np.zeros(len(own), dtype=np.int64)]
                out_up += [np.full(len(spokes), -1), np.full(len(own), b[s])]
            elif len(own) > 1:
                i, j = np.triu_indices(len(own), 1)
                out_a.append(own[i])
                out_b.append(own[j])
                out_up.append(np.full(len(i), -1))
        a, bb, up = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_up)
        if len(a):
            yield pd.DataFrame({"a": np.where(up < 0, np.minimum(a, bb), a), "b": np.where(up < 0, np.maximum(a, bb), bb), "bucket": up})

    for batch in batches:
        rows = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows["bucket"] == rows["bucket"].iloc[-1]) & (rows["salt"] == rows["salt"].iloc[-1])
        yield from work(rows[~last], True)
        carry = rows[last]
        if len(carry) > 4 * cap + 1000:
            yield from work(carry, False)
            carry = None
    if carry is not None:
        yield from work(carry, True)


def sets_of(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """c, s of the classes asked for. If they are few, by count, they go to the sets, so that only those are shuffled."""
    classes = materialise(classes, "classes")
    if classes.count() <= BROADCAST_ROWS:
        classes = F.broadcast(classes)
    return sets.select("c", "s").join(classes, "c", "left_semi").dropDuplicates(["c"])


def _candidates(sets: DataFrame, bands: int, width: int, cap: int, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """Distinct pairs a < b of classes that may be similar, with the star edges of large buckets; and the written stages that they are read from."""
    stages: list[DataFrame] = []
    rows, found = sets.select("c", "s", F.xxhash64("kind").alias("up")), None
    for level in range(levels):
        n, w = (bands, width) if level == 0 else (bands // 2, max(2, width // 2))
        banded = rows.mapInPandas(lambda b, n=n, w=w, level=level: _banded(b, n, w, level, cap), "bucket bigint, salt bigint, hot boolean, c bigint")
        # tasks grow in number with the keys, not in size
        parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * n // KEYS_A_TASK))
        edges = banded.repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "c").mapInPandas(lambda b: _edges(b, cap), EDGE)
        edges = materialise(edges, "edges")
        stages.append(edges)
        pairs = edges.where("bucket < 0").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        over = edges.where("bucket >= 0").select(F.col("a").alias("c"), F.col("bucket").alias("up")).distinct()
        if over.isEmpty():
            return found.distinct(), stages
        rows = materialise(over.join(sets_of(sets, over.select("c").distinct()), "c").select("c", "s", "up"), "large")
        stages.append(rows)
    # so many bins agree that these are results: all pairs of a bucket, block by block
    sizes = rows.groupBy("up").agg((F.count("*") / 64 + 1).cast("int").alias("m"))
    blocked = rows.select("c", "up").join(sizes, "up").withColumn("i", F.pmod(F.hash("c"), "m"))
    left = blocked.withColumn("j", F.explode(F.sequence("i", F.col("m") - 1))).select("up", "i", "j", F.col("c").alias("x"))
    right = blocked.withColumn("h", F.explode(F.sequence(F.lit(0), "i"))).select("up", F.col("h").alias("i"), F.col("i").alias("j"), F.col("c").alias("y"))
    rest = left.join(right, ["up", "i", "j"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return found.union(rest).distinct(), stages


def _verified(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for a, b, s, t in zip(batch["a"], batch["b"], batch["s"], batch["t"], strict=True):
            x, y = np.frombuffer(s, dtype=np.uint32), np.frombuffer(t, dtype=np.uint32)
            if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= threshold * (len(x) + len(y) - common) - 1e-9:
                out.append((a, b, common / (len(x) + len(y) - common)))
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])


def similar_classes(records: DataFrame, key: str, text: str, kind: Column, width: int, threshold: float, least_words: int, bands: int, band_width: int, cap: int, levels: int = 3) -> tuple[DataFrame, DataFrame]:
    """Members (kind, k, c) and verified links (a, b, similarity) between classes."""
    rows = records.select(kind.cast("string").alias("kind"), F.col(key).cast("string").alias("k"), F.col(text).alias("text")).where("text is not null and k is not null")
    sets = materialise(rows.mapInPandas(lambda b: _sets(b, width, least_words), "kind string, k string, c bigint, s binary"), "sets")
    candidates, stages = _candidates(sets, bands, band_width, cap, levels)
    pairs = materialise(candidates, "pairs")
    discard(*stages)
    wanted = materialise(sets_of(sets, pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()), "wanted")
    both = pairs.join(wanted.select(F.col("c").alias("a"), "s"), "a").join(wanted.select(F.col("c").alias("b"), F.col("s").alias("t")), "b")
    links = materialise(both.mapInPandas(lambda b: _verified(b, threshold), "a bigint, b bigint, similarity double"), "links")
    members = materialise(sets.select("kind", "k", "c").distinct(), "members")
    discard(sets, pairs, wanted)
    return members, links


def near_duplicate_pairs(records: DataFrame, key: str, text: str = "text", kind: Column | None = None, width: int = 5, threshold: float = 0.8, least_words: int = 1, bands: int = 44, band_width: int = 4, cap: int = 16, expand_copies: int = 256) -> DataFrame:
    """kind, key_a, key_b: records of one kind, key_a < key_b as text, that share at least threshold of their runs of width words.

    The share is of all distinct runs in either text; both need least_words words (and width). Texts of one set of
    runs are a pair too. A class of up to expand_copies such copies is written out in all its pairs; a larger one, of
    which the pairs would be its square, as pairs of each copy with the smallest key, which then stands for the class
    in its other pairs: membership and representatives say the same, and no link between different texts is lost.

    A pair at the threshold shares a bucket with probability 1 - (1 - threshold ** band_width) ** bands: 0.998 at 0.6,
    and 0.99999 from 0.7 on. Null texts and keys are left out, repeated rows count once, other columns are ignored.
    """
    members, links = similar_classes(records, key, text, kind if kind is not None else F.lit(""), width, threshold, least_words, bands, band_width, cap)
    classes = members.groupBy("kind", "c").agg(F.count("*").alias("n"), F.min("k").alias("least"))
    copies = members.join(classes.where("n > 1"), ["kind", "c"])
    small, large = copies.where(F.col("n") <= expand_copies), copies.where(F.col("n") > expand_copies)
    same = small.alias("x").join(small.alias("y"), (F.col("x.c") == F.col("y.c")) & (F.col("x.k") < F.col("y.k"))).select("x.kind", F.col("x.k").alias("key_a"), F.col("y.k").alias("key_b"))
    same = same.union(large.where("k <> least").select("kind", F.col("least").alias("key_a"), F.col("k").alias("key_b")))
    linked = materialise(links.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(members, "c").join(classes.select("c", "n", "least"), "c").where((F.col("n") <= expand_copies) | (F.col("k") == F.col("least"))).select("c", "kind", "k"), "linked")
    across = links.join(linked.select(F.col("c").alias("a"), "kind", F.col("k").alias("x")), "a").join(linked.select(F.col("c").alias("b"), F.col("k").alias("y")), "b")
    return same.union(across.select("kind", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (a, b): the smallest node it is joined with, by large-star and small-star.

    Each round sends a node's neighbours to the smallest of them, so paths shrink by powers; a round is written to the
    shared folder, and nothing but a count comes to the driver. A hub's neighbours are never gathered: all is
    aggregates and joins.
    """
    edges = materialise(edges.select("a", "b").where("a <> b"), "graph")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges, old = materialise(small, "small-star"), edges
        discard(old, large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct()).distinct()
        before = state


def near_duplicate_groups(records: DataFrame, key: str, text: str = "text", width: int = 5, threshold: float = 0.8, least_words: int = 1, bands: int = 44, band_width: int = 4, cap: int = 16) -> DataFrame:
    """key, class_id, group_id, n_copies, n_links: one row per record with at least width words.

    class_id stands for the texts of one set of runs, group_id for all classes joined by links, directly or through
    others; n_copies counts the class, n_links its links to other classes. Arguments as for near_duplicate_pairs.
    """
    members, links = similar_classes(records, key, text, F.lit(""), width, threshold, least_words, bands, band_width, cap)
    counts = members.groupBy("c").agg(F.count("*").alias("n_copies"))
    degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("n_links"))
    roots = components(links)
    out = members.join(counts, "c").join(degree, "c", "left").join(roots.select(F.col("node").alias("c"), "root"), "c", "left")
    return out.select(F.col("k").alias(key), F.col("c").alias("class_id"), F.coalesce("root", "c").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
