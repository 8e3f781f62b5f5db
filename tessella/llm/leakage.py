"""Evaluation texts leaking into training text: a positional inverted index, sharded by documents.

Every shard holds the postings of some documents: for each term of the test items the places where it occurs, all
documents of the shard laid out on one axis with gaps between them. The index is written to the shared folder and then
searched shard by shard, so neither postings nor documents are shuffled. A test item is searched by blocks of half the
phrase length: whatever run of min_words words a document shares with it covers one block whole. A block's posting
lists are shifted by the places of their terms in the item and intersected, the shard's rarest term first; what
remains is a place where the block occurs, and is extended to both sides as far as the lists allow. A shard doesn't try
every item: blocks are filed under the term of theirs that fewest blocks have, and a shard looks up its own terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import words
from tessella.session import materialise

#: Places left free between two documents on a shard's axis.
SPACE = 256
INDEX = "docs array<{kind}>, bases array<int>, terms binary, ends binary, places binary"


class Items:
    """Test items as term numbers; their blocks of half min_words terms, filed under the rarest term of each."""

    def __init__(self, rows: list[tuple[Any, str | None]], min_words: int):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for key, text in rows:
            terms = words(text)
            if len(terms) >= min_words:
                self.items.append((key, np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in terms], dtype=np.int32)))
        half = (min_words + 1) // 2
        starts = [np.arange(0, len(t) - half + 1, half) for _, t in self.items]
        self.of = np.repeat(np.arange(len(self.items)), [len(b) for b in starts])
        self.at = np.concatenate([*starts, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.terms = np.array([self.items[i][1][b : b + half] for i, b in zip(self.of, self.at, strict=True)], dtype=np.int32).reshape(-1, half)
        often = np.bincount(self.terms.ravel(), minlength=len(self.vocabulary))
        filed = self.terms[np.arange(len(self.terms)), often[self.terms].argmin(1)] if len(self.terms) else np.zeros(0, dtype=np.int32)
        self.order = np.argsort(filed, kind="stable")
        self.first = np.searchsorted(filed[self.order], np.arange(len(self.vocabulary) + 1))
        self.flat = np.concatenate([*[t for _, t in self.items], np.zeros(0, dtype=np.int32)]).astype(np.int64)
        self.begins = np.cumsum([0, *[len(t) for _, t in self.items]])

    def blocks_in(self, count: np.ndarray, present: np.ndarray) -> dict[int, list[int]]:
        """item -> the places of its blocks of which all terms are present."""
        low, high = self.first[present], self.first[present + 1]
        ix = self.order[np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True) if b > a] or [np.zeros(0, dtype=np.int64)])]
        ix = np.sort(ix[(count[self.terms[ix]] > 0).all(axis=1)])
        out: dict[int, list[int]] = {}
        for i, b in zip(self.of[ix].tolist(), self.at[ix].tolist(), strict=True):
            out.setdefault(i, []).append(b)
        return out

    def nearly_in(self, count: np.ndarray, min_words: int, need: int) -> np.ndarray:
        """Items of which some window of min_words words has need words present."""
        there = np.concatenate(([0], np.cumsum(count[self.flat] > 0)))
        n = len(self.flat) - min_words + 1
        window = np.zeros(len(self.flat), dtype=bool)
        if n > 0:
            window[:n] = there[min_words:] - there[:n] >= need
        window &= np.arange(len(self.flat)) <= np.repeat(self.begins[1:], np.diff(self.begins)) - min_words
        return np.unique(np.searchsorted(self.begins, np.flatnonzero(window), side="right") - 1)


def build_shards(batches: Iterator[pd.DataFrame], vocabulary: dict[str, int], shard_words: int) -> Iterator[pd.DataFrame]:
    get = vocabulary.get
    docs, bases, found, at, base = [], [], [], [], 0

    def shard() -> pd.DataFrame:
        terms = np.concatenate(found)
        order = np.argsort(terms, kind="stable")
        kinds, starts = np.unique(terms[order], return_index=True)
        ends = np.append(starts[1:], len(terms)).astype(np.int32)
        places = np.concatenate(at)[order]
        return pd.DataFrame({"docs": [list(docs)], "bases": [list(bases)], "terms": [kinds.astype(np.int32).tobytes()], "ends": [ends.tobytes()], "places": [places.astype(np.int32).tobytes()]})

    for batch in batches:
        for key, text in zip(batch["k"], batch["text"], strict=True):
            ids = np.array([get(w, -1) for w in words(text)], dtype=np.int32)
            known = np.flatnonzero(ids >= 0)
            if len(known):
                docs.append(key)
                bases.append(base)
                found.append(ids[known])
                at.append(known + base)
            base += len(ids) + SPACE
            if base >= shard_words:
                if docs:
                    yield shard()
                docs, bases, found, at, base = [], [], [], [], 0
    if docs:
        yield shard()


class Shard:
    def __init__(self, terms: bytes, ends: bytes, places: bytes, n_terms: int):
        kinds, ends = np.frombuffer(terms, dtype=np.int32), np.frombuffer(ends, dtype=np.int32)
        self.places = np.frombuffer(places, dtype=np.int32)
        self.start, self.end = np.zeros(n_terms, dtype=np.int64), np.zeros(n_terms, dtype=np.int64)
        self.start[kinds], self.end[kinds] = np.concatenate(([0], ends[:-1])), ends
        self.count = self.end - self.start

    def has(self, term: int, at: np.ndarray, slop: int = 0) -> np.ndarray:
        """For each place, whether the term stands there, or not more than slop places away."""
        own = self.places[self.start[term] : self.end[term]]
        if not len(own):
            return np.zeros(len(at), dtype=bool)
        i = np.searchsorted(own, at - slop)
        return (i < len(own)) & (own[np.minimum(i, len(own) - 1)] <= at + slop)

    def runs(self, item: np.ndarray, min_words: int, blocks: list[int]) -> Iterator[tuple[int, int, int]]:
        """Place on the axis, place in the item and length of every run of min_words words or more that has one of the blocks."""
        half = (min_words + 1) // 2
        counts, done = self.count[item], set()
        for b in blocks:
            order = b + np.argsort(counts[b : b + half], kind="stable")
            rarest = int(order[0])
            lines = self.places[self.start[item[rarest]] : self.end[item[rarest]]] - rarest  # places shifted to where the item would begin
            for j in order[1:]:
                lines = lines[self.has(int(item[j]), lines + int(j))]
                if not len(lines):
                    break
            for line in lines.tolist():
                low, high = b, b + half
                while low > 0 and self.has(int(item[low - 1]), np.array([line + low - 1]))[0]:
                    low -= 1
                while high < len(item) and self.has(int(item[high]), np.array([line + high]))[0]:
                    high += 1
                if high - low >= min_words and (line, low) not in done:
                    done.add((line, low))
                    yield line + low, low, high - low

    def near(self, item: np.ndarray, min_words: int, slop: int, share: float) -> Iterator[tuple[int, int, int]]:
        """The same for all windows of min_words item words of which a share stands within slop places of its due place: words changed, dropped or put in."""
        counts, need = self.count[item], int(np.ceil(share * min_words))
        # of any need words in a window one is among its rarest ones, as many as may be absent and one more
        spans = np.lib.stride_tricks.sliding_window_view(counts, min_words)
        rare = np.unique(np.arange(len(spans))[:, None] + np.argsort(spans, axis=1, kind="stable")[:, : min_words - need + 1])
        lines = np.unique(np.concatenate([self.places[self.start[item[j]] : self.end[item[j]]] - int(j) for j in rare]))
        # where a line goes on through the item, each word is looked up once for all windows
        for low in range(0, len(lines), 10_000):
            part = lines[low : low + 10_000]
            hits = np.stack([np.zeros(len(part), dtype=np.int64), *[self.has(int(t), part + j, slop) for j, t in enumerate(item)]])
            total = np.cumsum(hits, axis=0)
            inside = total[min_words:] - total[:-min_words]
            for b, i in zip(*np.nonzero(inside >= need), strict=True):
                yield int(part[i]) + int(b), int(b), int(inside[b, i])


def search_shards(batches: Iterator[pd.DataFrame], items: Items, min_words: int, slop: int, share: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            shard = Shard(row.terms, row.ends, row.places, len(items.vocabulary))
            bases, out = np.asarray(row.bases), []
            hits = [(i, "phrase", h) for i, blocks in items.blocks_in(shard.count, np.frombuffer(row.terms, dtype=np.int32)).items() for h in shard.runs(items.items[i][1], min_words, blocks)]
            if slop:
                near = items.nearly_in(shard.count, min_words, int(np.ceil(share * min_words)))
                hits += [(int(i), "proximity", h) for i in near for h in shard.near(items.items[i][1], min_words, slop, share)]
            for i, kind, (place, low, n) in hits:
                d = int(np.searchsorted(bases, max(place, 0), side="right")) - 1
                out.append((row.docs[d], items.items[i][0], kind, int(place - bases[d]), low, n))
            if out:
                yield pd.DataFrame(out, columns=["k", "i", "kind", "doc_word", "item_word", "n_words"])


def leaked_passages(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", min_words: int = 12, slop: int = 0, share: float = 0.8, block_words: int = 2_000_000, shard_words: int = 500_000) -> DataFrame:
    """key, item, kind, doc_word, item_word, n_words: where documents hold at least min_words successive words of a passage.

    kind is "phrase" for an unbroken run, with its first word in document and passage (from 0) and its full length.
    With slop above 0 there are also rows "proximity", for all windows of min_words passage words of which a share stands
    within slop places of where it should; n_words says how many do.

    Passages are worked through in blocks of block_words words, which bounds what is sent to the executors (some 100
    MB); each block makes an index of its own terms. shard_words bounds a shard, so one of the index's rows takes a
    few MB; a longer document is a shard of its own. Null or empty texts and passages, and passages of fewer words
    than min_words, match nothing. Repeated rows give repeated rows; other columns are ignored.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("text")).where("text is not null")
    kind, of_item = rows.schema["k"].dataType.simpleString(), items.schema[item].dataType.simpleString()
    found = spark.createDataFrame([], f"k {kind}, i {of_item}, kind string, doc_word int, item_word int, n_words int")

    def search(block: list) -> DataFrame | None:
        own = Items(block, min_words)
        if not own.items:
            return None
        sent = spark.sparkContext.broadcast(own)
        index = rows.mapInPandas(lambda b: build_shards(b, sent.value.vocabulary, shard_words), INDEX.format(kind=kind))
        index = materialise(index, "postings")
        return index.mapInPandas(lambda b: search_shards(b, sent.value, min_words, slop, share), found.schema)

    # one block at a time is held; the last one may be empty
    block, size = [], 0
    for r in chain(items.select(item, passage).where(F.col(passage).isNotNull()).toLocalIterator(), [None]):
        if r is not None:
            block.append((r[0], r[1]))
            size += len(r[1]) // 4
        if (r is None or size >= block_words) and (more := search(block)) is not None:
            found = found.union(more)
        if size >= block_words:
            block, size = [], 0
    return found.withColumnsRenamed({"k": key, "i": item})
