"""Filling fixed-capacity containers with texts along a space-filling curve.

A text is a vector of hashed words, projected to a few dimensions by signs that the hashes themselves supply; its
place on a Hilbert curve through that space is its key. Texts are sorted by key in ranges over the cluster, and each
range is packed on its own: an item goes to the open container it fills best, the fullest is closed when too many are
open. So a container's texts are neighbours on the curve. What a range leaves open is packed once more, in ranges of
open containers, until little is left.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.near_duplicates import WordHashes
from tessella.llm.words import mix, words
from tessella.session import materialise

DIMENSIONS, BITS = 4, 12


#: Fixed value: the pattern that splits a text before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(ranks_file: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """A public tokenizer from its rank file: a line per token, in base 64, with its rank."""
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(ranks_file.rsplit("/", 1)[-1], pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of unsigned cell numbers (Skilling's transform, published 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            swapped = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swapped)
            x[i] ^= swapped
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_places(texts: list[str], hashes: WordHashes) -> np.ndarray:
    """The key of each text: its words' hashes, projected by their own bits, scaled to its length, on the curve."""
    out = np.zeros((len(texts), DIMENSIONS))
    for i, text in enumerate(texts):
        h = hashes(words(text))
        if len(h):
            for d in range(DIMENSIONS):
                signs = (mix(h + np.uint64(d * 0x9E3779B9 + 1)) >> np.uint64(63)).astype(np.int64) * 2 - 1
                out[i, d] = signs.sum() / math.sqrt(len(h))
    share = 1 / (1 + np.exp(-1.702 * np.clip(out, -20, 20)))  # close to the normal distribution, so that cells fill evenly
    return hilbert_keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


class Packer:
    """Best fit among at most most_open containers. A container is [left, key of its first item, items]."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.open: list[tuple[int, int]] = []  # left, number; sorted
        self.held: dict[int, list] = {}
        self.n = 0

    def put(self, size: int, item) -> list | None:
        """Puts an item away; returns a container that is closed by it, if one is."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            left, number = self.open.pop(at)
            self.held[number].append(item)
        else:
            left, number = self.capacity, self.n
            self.n += 1
            self.held[number] = [item]
        left -= size
        if left == 0:
            return self.held.pop(number)
        insort(self.open, (left, number))
        if len(self.open) > self.most_open:
            return self.held.pop(self.open.pop(0)[1])
        return None

    def rest(self) -> Iterator[tuple[int, list]]:
        for left, number in self.open:
            yield self.capacity - left, self.held[number]


def _measured(batches: Iterator[pd.DataFrame], folder: str, name: str, capacity: int) -> Iterator[pd.DataFrame]:
    """A row per piece: k, piece, start, size, place."""
    encoder, hashes = tokenizer(f"{folder}/{name}"), WordHashes()
    for batch in batches:
        places = curve_places(list(batch["text"]), hashes)
        rows = []
        for key, text, place in zip(batch["k"], batch["text"], places, strict=True):
            n = len(encoder.encode_ordinary(text))
            for piece in range(max(1, -(-n // capacity))):
                rows.append((key, piece, piece * capacity, min(capacity, n - piece * capacity), place))
        yield pd.DataFrame(rows, columns=["k", "piece", "start", "size", "place"])


def _packed(batches: Iterator[pd.DataFrame], capacity: int, most_open: int) -> Iterator[pd.DataFrame]:
    """Groups (size, place, members) in order of place to containers (used, place, members, closed)."""
    packer = Packer(capacity, most_open)
    columns = ["used", "place", "members", "closed"]

    def row(items: list, closed: bool) -> tuple:
        return sum(i[0] for i in items), min(i[1] for i in items), [m for i in items for m in i[2]], closed

    for batch in batches:
        out = []
        for size, place, members in zip(batch["size"], batch["place"], batch["members"], strict=True):
            done = packer.put(size, (size, place, list(members)))
            if done is not None:
                out.append(row(done, True))
        if out:  # an empty frame has no type for its nested column
            yield pd.DataFrame(out, columns=columns)
    if left := [row(items, False) for _, items in packer.rest()]:
        yield pd.DataFrame(left, columns=columns)


MEMBERS = "array<struct<k:{0},piece:int,start:int,size:int>>"


def pack(texts: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", folder: str = "/opt/tokenizers", name: str = "byte_bpe_50k.tiktoken", most_open: int = 64, rounds: int = 3) -> DataFrame:
    """container, key, piece, start, n_tokens, used: every text, or piece of a text, in a container of capacity tokens.

    A text longer than the capacity is cut into pieces of capacity tokens and a rest; no other is cut. start is the
    piece's first token, used the tokens of the container. The name of a container is its first member's key and
    piece. Null texts and keys are left out; texts without a token take no space and go along. A repeated key counts
    once; other columns are ignored. folder, on every executor, holds the public tokenizers.

    Ranges are bounded by rows, so the copies of one text, which share a place, are spread over tasks too. Each of
    rounds packs what the one before left open, in a sixteenth of its ranges.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = texts.sparkSession
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("text")).where("k is not null and text is not null").dropDuplicates(["k"])
    kind = rows.schema["k"].dataType.simpleString()
    items = rows.mapInPandas(lambda b: _measured(b, folder, name, capacity), f"k {kind}, piece int, start int, size int, place bigint")
    items = materialise(items, "items")
    full = items.where(F.col("size") == capacity)
    members = MEMBERS.format(kind)
    closed = full.select("size", F.array(F.struct("k", "piece", "start", "size")).cast(members).alias("members"))
    left = items.where(F.col("size") < capacity).select("size", "place", F.array(F.struct("k", "piece", "start", "size")).cast(members).alias("members"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(rounds):
        # the first member's key parts equal places
        sorted_ = left.repartitionByRange(ranges, "place", F.col("members")[0]["k"]).sortWithinPartitions("place", F.col("members")[0]["k"])
        packed = materialise(sorted_.mapInPandas(lambda b: _packed(b, capacity, most_open), f"used int, place bigint, members {members}, closed boolean"), "packed")
        last = turn == rounds - 1 or ranges == 1
        done = packed if last else packed.where("closed")
        closed = closed.union(done.select(F.col("used").alias("size"), "members"))
        if last:
            break
        left = packed.where("not closed").select(F.col("used").alias("size"), "place", "members")
        ranges = max(1, ranges // 16)
    first = F.array_min(F.transform("members", lambda m: F.struct(m["k"].alias("k"), m["piece"].alias("piece"))))
    named = closed.select(F.concat_ws(":", first["k"].cast("string"), first["piece"].cast("string")).alias("container"), F.col("size").alias("used"), F.explode("members").alias("m"))
    return named.select("container", F.col("m.k").alias(key), F.col("m.piece").alias("piece"), F.col("m.start").alias("start"), F.col("m.size").alias("n_tokens"), "used")
