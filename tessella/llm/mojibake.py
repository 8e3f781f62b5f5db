"""Garbled text from wrong character encodings: best-first search over encode, decode and unescape steps.

A corpus model gives every pair of neighbouring characters that holds a non-ASCII one its frequency over all
documents, or over their distinct segments if that is less; a text's cost is the sum of their surprisals plus fixed penalties for characters that no text has. Texts
are searched segment by segment (sentence or line), since often only a part is garbled: states are strings, a step
encodes in one encoding and decodes in another, or unescapes character references; the cheapest state is expanded
first, states seen before (by hash) are not, and the cheapest one reached wins if it is cheaper by a margin.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings in which bytes were misread, and those in which they were written.
READ_AS = ("latin-1", "cp1252", "cp437", "mac_roman", "cp1251", "cp1250", "koi8_r")
WRITTEN_IN = ("utf-8", "cp1251", "koi8_r", "iso8859_2", "cp1250", "cp1252")
#: Surprisals lie between 0 and this; it also stands for pairs that the corpus lacks.
MOST = 16.0
CONTROL = re.compile("[\x80-\x9f]")
LOST = "�"
FRAMES = re.compile("[─-▟]")
SEGMENT = re.compile(r"(?<=[.!?])( +)|(\n+)")
REFERENCE = re.compile(r"&(?:#\d{2,7}|#x[0-9a-fA-F]{2,6}|[A-Za-z]{2,31}\d{0,2});")
WIDE = re.compile(r"[^\x00-\x7f]")
PAIR = re.compile(r"[^\x00-\x7f]{2}")


def _encoder(name: str) -> dict[int, int]:
    """Code point to byte; bytes that the encoding leaves undefined stand for themselves, as lenient readers have them."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


ENCODERS = {name: _encoder(name) for name in READ_AS}


def encode(text: str, name: str) -> bytes | None:
    table = ENCODERS[name]
    try:
        return bytes([table[ord(c)] for c in text])
    except KeyError:
        return None


def pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        joined = "\n".join(t for t in batch["text"] if t is not None and not t.isascii()).lower()
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        wide = (codes[:-1] > 127) | (codes[1:] > 127)
        keys, counts = np.unique((codes[:-1][wide] << 21) | codes[1:][wide], return_counts=True)
        yield pd.DataFrame({"pair": keys, "n": counts.astype(np.int64)})


def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The segments that hold a non-ASCII character, once a batch."""
    for batch in batches:
        found = {part for t in set(batch["text"]) if t is not None and not t.isascii() for part in SEGMENT.split(t) if part and not part.isascii()}
        yield pd.DataFrame({"text": list(found)}, dtype=object)


def pair_model(texts: DataFrame, most_pairs: int = 200_000) -> dict[int, float]:
    """Surprisal of each pair of neighbours: by its share in all texts, or in their distinct segments, whichever is less.

    So a garbled text doesn't become usual by being copied, nor one that few rows have by there being few others. The
    model keeps the most_pairs commonest ones; the rest cost as much as unseen ones. That bounds what is sent to the
    driver and back (some 5 MB), and no text is left out by it.
    """
    distinct = texts.mapInPandas(segments, "text string").distinct()
    schema = "pair bigint, n bigint"
    both = texts.mapInPandas(pair_counts, schema).select("pair", "n", F.lit(0).cast("bigint").alias("d")).union(distinct.mapInPandas(pair_counts, schema).select("pair", F.lit(0).cast("bigint"), "n"))
    kept = both.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).orderBy(F.desc("n"), "pair").limit(most_pairs).collect()
    total, once = sum(r.n for r in kept), sum(r.d for r in kept)
    return {r.pair: min(MOST, max(-math.log(r.n / total), -math.log(r.d / once))) for r in kept if r.n and r.d}


class Repair:
    """Search with a model of pairs. margin: by how much a pair must get cheaper on average where a step doesn't prove itself."""

    def __init__(self, model: dict[int, float], margin: float = 1.5, suspect: float = 11.5, mean: float = 7.5, expansions: int = 48):
        self.model, self.margin, self.suspect, self.mean, self.expansions = model, margin, suspect, mean, expansions
        self.exhausted = False  # whether a search of the document at hand ended with states left

    def cost(self, text: str) -> tuple[float, int, float]:
        """Sum, number and maximum of the surprisals."""
        get, low = self.model.get, text.lower()
        total, n, worst, before = 0.0, 0, 0.0, 10
        for c in map(ord, low):
            if c > 127 or before > 127:
                x = get((before << 21) | c, MOST)
                total, n = total + x, n + 1
                if x > worst:
                    worst = x
            before = c
        fixed = 40.0 * (len(CONTROL.findall(text)) + len(FRAMES.findall(text))) + 60.0 * text.count(LOST)
        if "&" in text:
            fixed += 25.0 * len(REFERENCE.findall(text))
        return total + fixed, n, worst

    def steps(self, text: str, single: bool) -> Iterator[tuple[str, str, bool]]:
        """What one step makes of a text: the step, the text, and whether it proves itself by being possible."""
        if "&" in text and REFERENCE.search(text):
            yield "unescape", html.unescape(text), True
        if text.isascii():
            return
        for read in READ_AS:
            if (data := encode(text, read)) is None:
                continue
            for written in WRITTEN_IN if single else WRITTEN_IN[:1]:
                if written == read or (written == "utf-8" and not PAIR.search(text)):
                    continue
                try:
                    out = data.decode(written)
                except UnicodeDecodeError:
                    continue
                if out != text:
                    yield f"{read}>{written}", out, written == "utf-8"

    def search(self, text: str, single: bool) -> tuple[str, tuple[str, ...]]:
        """The cheapest text that can be reached, and the steps to it."""
        start = self.cost(text)[0]
        best, heap, seen, tick = (start, text, ()), [(start, 0, text, ())], {hash(text)}, 0
        for _ in range(self.expansions):
            if not heap:
                break
            cost, _, state, path = heapq.heappop(heap)
            if cost < best[0]:
                best = (cost, state, path)
            if len(path) >= 4:
                self.exhausted = True
                continue
            now, n, _ = self.cost(state)
            for step, out, sure in self.steps(state, single):
                if (h := hash(out)) in seen:
                    continue
                seen.add(h)
                then = self.cost(out)[0]
                if sure or now - then >= self.margin * max(n, 8):  # one single-byte encoding for another always decodes: only a clear gain counts
                    tick += 1
                    heapq.heappush(heap, (then + 0.5 * (len(path) + 1), tick, out, (*path, step)))
        self.exhausted |= bool(heap)
        return best[1], best[2]

    def segment(self, text: str) -> tuple[str, tuple[str, ...], bool]:
        """A segment's repair: text, steps, and whether characters are lost for good."""
        reference = "&" in text and REFERENCE.search(text)
        if text.isascii() and not reference:
            return text, (), False
        total, n, worst = self.cost(text)
        odd = n and (worst >= self.suspect or total >= self.mean * n)
        if not (reference or odd or PAIR.search(text) or CONTROL.search(text)):
            return text, (), LOST in text
        fixed, path = self.search(text, bool(odd))
        if not path and odd:  # a part of the segment may be garbled, so that the whole doesn't encode
            words = text.split(" ")
            done = [(w, ()) if w.isascii() else self.search(w, False) for w in words]
            path = tuple(dict.fromkeys(s for _, p in done for s in p))
            fixed = " ".join(w for w, _ in done) if path else text
        return fixed, path, LOST in fixed or bool(CONTROL.search(fixed))

    def document(self, text: str | None) -> tuple[str | None, list[str], bool]:
        self.exhausted = False
        if not text or (text.isascii() and "&" not in text):
            return text, [], False
        out, steps, lost = [], {}, False
        for part in SEGMENT.split(text):
            if part:
                fixed, path, gone = self.segment(part)
                out.append(fixed)
                steps.update(dict.fromkeys(path))
                lost |= gone
        return "".join(out), list(steps), lost


def repair_encoding(documents: DataFrame, key: str = "doc_id", text: str = "text", garbled_only: bool = False, **options: Any) -> DataFrame:
    """key, restored, steps, lost, exhausted, garbled of every document; with garbled_only of those that are garbled.

    A search opens 48 states at most and goes four steps deep; exhausted says that one of the document's searches had
    states left then, so that a cheaper text may exist.

    steps names what was undone ("cp1252>utf-8"), lost says that characters can't be brought back (U+FFFD, or control
    characters that remain); a document is garbled if it has steps or lost is true. What isn't garbled comes back
    unchanged, null as null, empty as empty. Repeated rows give repeated rows; other columns are ignored. Counts
    cover all documents, and copies carry no weight (pair_model); each document is worked on alone, so neither skewed keys nor long texts meet in a task.
    """
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("text"))
    model = documents.sparkSession.sparkContext.broadcast(pair_model(rows.select("text").where("text is not null")))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(model.value, **options)
        for batch in batches:
            done = [(*repair.document(t), repair.exhausted) for t in batch["text"]]
            out = pd.DataFrame({"k": batch["k"], "restored": [d[0] for d in done], "steps": [d[1] for d in done], "lost": [d[2] for d in done], "exhausted": [d[3] for d in done]})
            out["garbled"] = (out["steps"].str.len() > 0) | out["lost"]
            out = out[out["garbled"]] if garbled_only else out
            if len(out):  # an empty frame has no type for its nested column
                yield out

    found = rows.mapInPandas(run, f"k {kind}, restored string, steps array<string>, lost boolean, exhausted boolean, garbled boolean")
    return found.withColumnRenamed("k", key)
