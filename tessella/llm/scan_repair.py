"""Noise in text from scanned pages: running heads, page numbers, words cut at line ends, misread characters.

Heads and feet are lines at page edges that recur, compared by skeletons in which characters that recognition confuses
are one, and fuzzily; page numbers are number forms that count up in step with the pages. What is left is body text.
A word that ends a line with a hyphen is joined with the next body line's first word if the corpus vocabulary has the
joined word, or doesn't have the compound that its hyphen would make. A word that the vocabulary lacks is misread if
its skeleton is that of a word which the vocabulary has, and torn if it and its neighbour together are one.

The vocabulary is that of a corpus and grows with it. It stays distributed: units (a file's pages) ask for the words
that are not among the commonest, and only what was asked comes back to them.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import lookalikes
from tessella.session import materialise

# What recognition confuses; the left sides become the right ones, in this order.
CONFUSED = (("rn", "m"), ("vv", "w"), ("ii", "u"), ("0", "o"), ("1", "l"), ("i", "l"), ("|", "l"), ("5", "s"), ("8", "b"), ("6", "b"), ("h", "b"), ("e", "c"), ("q", "g"), ("9", "g"), ("t", "f"))
# A character that two others are taken for, which a skeleton can't hold.
MERGED = (("h", "li"),)
HYPHENS = "-‐¬\xad"
#: other dirt that must not look like this one: wide forms, kinds of blanks, signs without width; hyphens stay
PLAIN = {c: x for c, x in lookalikes.PLAIN.items() if chr(c) not in HYPHENS}
OTHER_DIRT = re.compile("[" + "".join(map(re.escape, map(chr, PLAIN))) + "]")
WORD = re.compile(r"[^\W_]+")
#: words for the vocabulary, compounds too
TERM = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
CUT = re.compile(rf"([^\W\d_]+(?:-[^\W\d_]+)*)([{HYPHENS}])$")
FIRST = re.compile(r"^[“”\"'’(\[]*([^\W_]+)")
NUMBER = r"[0-9lIOoS|]{1,4}"
ROMAN = re.compile(r"^[ivxlcIVXLC]{1,7}$")
#: forms of page numbers, of which a whole line consists; the last ones have a head or foot beside the number
FORMS = {
    "of": re.compile(rf"^\W*(\w{{4}})\.?\s*({NUMBER})\s+(\w{{2}})\s+({NUMBER})\W*$"),
    "dashed": re.compile(rf"^[-–—]\s*({NUMBER})\s*[-–—]$"),
    "boxed": re.compile(rf"^\[\s*({NUMBER})\s*\]$"),
    "slash": re.compile(rf"^({NUMBER})\s*/\s*({NUMBER})$"),
    "plain": re.compile(rf"^({NUMBER})$"),
    "page_text": re.compile(rf"^[pP]\.?\s*({NUMBER})\s+(\S.*)$"),
    "text_page": re.compile(rf"^(\S.*?\S)\s{{2,}}({NUMBER})$"),
    "bar_text": re.compile(rf"^({NUMBER})\s*[|·•]\s*(\S.*)$"),
    "text_bar": re.compile(rf"^(\S.*?\S)\s*[|·•]\s*({NUMBER})$"),
}
#: a number at either end, or behind a word of four letters or fewer, which all forms but the Roman one have
EDGE_NUMBER = re.compile(rf"^\W*(?:\w{{1,4}}\W{{1,3}})?{NUMBER}\b|{NUMBER}\W*$")
STRONG = ("of", "dashed", "boxed", "slash")
LONGEST_HEAD = 90
#: lines that lie between two page edges at least
APART = 4
#: pages between two of one head or one way to count that are near to each other, left and right ones and one that is missed
NEARBY = 4


def skeleton(text: str) -> str:
    out = text.lower()
    for a, b in CONFUSED:
        out = out.replace(a, b)
    return out


def parted(word: str) -> list[str]:
    """The word with one of its characters as the two that may have been taken for it."""
    return [word[:i] + two + word[i + 1 :] for one, two in MERGED for i, c in enumerate(word) if c == one]


PAGE, OF = skeleton("page"), skeleton("of")


def as_number(text: str) -> int | None:
    """A number, with letters that look like digits read as such; None if nothing in it is a digit."""
    if not any(c.isdigit() for c in text):
        return None
    text = text.translate(str.maketrans("lI|OoS", "111005"))
    return int(text) if text.isdigit() else None


def roman(text: str) -> int | None:
    if not ROMAN.match(text):
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in text.lower()]
    return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0], strict=True))


@lru_cache(maxsize=4096)
def page_form(line: str) -> tuple[str, int, str] | None:
    """Form, number, and the text beside it."""
    line = line.strip()
    if not line or len(line) > LONGEST_HEAD or (len(line) > 7 and not EDGE_NUMBER.search(line)):
        return None
    if (m := FORMS["of"].match(line)) and skeleton(m[1]) == PAGE and skeleton(m[3]) == OF and (n := as_number(m[2])) is not None:
        return "of", n, ""
    for form in ("dashed", "boxed", "slash", "plain"):
        if (m := FORMS[form].match(line)) and (n := as_number(m[1])) is not None:
            return form, n, ""
    if (n := roman(line)) is not None:
        return "roman", n, ""
    for form, number, text in (("page_text", 1, 2), ("bar_text", 1, 2), ("text_page", 2, 1), ("text_bar", 2, 1)):
        if (m := FORMS[form].match(line)) and (n := as_number(m[number])) is not None:
            return form, n, m[text]
    return None


def head_key(line: str) -> str:
    """A line as it is compared: without its page number, digits all alike, by skeleton."""
    form = page_form(line)
    text = form[2] if form and form[2] else line
    return skeleton(re.sub(r"\d+", "#", " ".join(text.split())))


def headlike(line: str) -> bool:
    """Whether a line can be a head or foot: short, not begun in lower case, not ended like a sentence, no row of numbers."""
    line = line.strip()
    return 2 < len(line) <= LONGEST_HEAD and (not line[0].islower() or page_form(line) is not None) and line[-1] not in ".,;:-" and len(re.findall(r"\d+", line)) <= 3


def alike(a: str, b: str) -> bool:
    """Whether two keys are one head: fuzzily equal, or one the other with something behind it, as on left and right pages."""
    if a == b:
        return True
    if len(a.split()) > 6 or len(b.split()) > 6:
        return False
    n = min(len(a), len(b))
    if n < 8 or abs(len(a) - len(b)) > 25:
        return False
    if abs(len(a) - len(b)) > 3:
        a, b = a[:n], b[:n]
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() >= 0.86 and m.ratio() >= 0.86


def _page_length(run: list[tuple[int, int]]) -> float | None:
    """Lines a page in a run of page numbers; None of a single one."""
    return median((b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(run, run[1:], strict=False)) if len(run) > 1 else None


@dataclass
class Unit:
    """A file's lines in order, with the record and page of each; page is None where pages aren't known."""

    texts: list[str]
    pages: list[int | None]
    #: lines of pages that only show what recurs: they belong to another stretch of the file
    aside: set[int] = field(default_factory=set)
    furniture: set[int] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.full = [i for i, t in enumerate(self.texts) if t.strip()]

    def edges(self) -> dict[int, int]:
        """Lines at the edges of known pages, with their page; none where pages aren't known."""
        by: dict[int, list[int]] = {}
        for i in self.full:
            if self.pages[i] is not None:
                by.setdefault(self.pages[i], []).append(i)
        return {i: p for p, lines in by.items() for i in {*lines[:3], *lines[-3:]}}

    def numbers(self) -> set[int]:
        """Lines that hold a page number."""
        forms: dict[str, list[tuple[int, int]]] = {}
        for i in self.full:
            if found := page_form(self.texts[i]):
                forms.setdefault(found[0], []).append((i, found[1]))
        edges, out = self.edges(), set()
        for form, items in forms.items():
            if edges:
                on_edge = [(i, n) for i, n in items if i in edges]
                offsets: dict[int, set[int]] = {}
                for i, n in on_edge:
                    offsets.setdefault(n - edges[i], set()).add(edges[i])
                out |= {i for i, n in on_edge if form in STRONG or self._counts_up(offsets[n - edges[i]], edges[i], len(set(edges.values())), form == "plain")}
            listed = {i for i, _ in items if form == "plain" and i and (self.texts[i - 1].rstrip().endswith(":") or FORMS["plain"].match(self.texts[i - 1].strip()))}
            chains = self._chains([x for x in items if x[0] not in listed])
            if form in STRONG:
                whole = {x for chain in chains if len(chain) >= 2 for x in chain}
                if whole or len(items) == 1:
                    out |= {i for i, n in items if form != "boxed" or (i, n) in whole or len(items) == 1}
                continue
            for k, chain in enumerate(chains):
                last = self.full and chain[-1][0] == self.full[-1]
                # a second run of two could be chance, and so could one of three bare numbers: it must have the page length of the first
                if len(chain) >= (2 if form != "plain" or last else 3) and (k == 0 or len(chain) >= 4 or self._paced(chain, chains[0])):
                    out |= {i for i, _ in chain}
                if len(chain) >= 2 and form == "plain" and (k == 0 or {i for i, _ in chain} <= out):
                    # a page may end right behind a list of numbers
                    gaps = [b[0] - a[0] for a, b in zip(chain, chain[1:], strict=False)]
                    for i, n in items:
                        if i in listed and any(abs(n - m) == 1 and abs(i - j) >= 0.5 * min(gaps) for j, m in chain) and n not in {m for _, m in chain}:
                            out.add(i)
        return out

    @staticmethod
    def _counts_up(with_offset: set[int], page: int, n_pages: int, plain: bool) -> bool:
        """Whether the pages on which numbers have one offset from the page make it that of page numbers at a page.

        Two pages do, for bare numbers half of all pages, or three pages near to this one that are half of those they span.
        """
        if len(with_offset) >= (2 if not plain else max(2, n_pages / 2)):
            return True
        part = [page]
        for step in (-1, 1):
            at = page
            while x := next((at + step * k for k in range(1, NEARBY + 1) if at + step * k in with_offset), None):
                part.append(at := x)
        return len(part) >= 3 and len(part) * 2 > max(part) - min(part)

    @staticmethod
    def _paced(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> bool:
        """Whether two runs have about the same number of lines a page."""
        x, y = _page_length(a), _page_length(b)
        return bool(x and y) and 0.5 <= x / y <= 2

    @staticmethod
    def _chains(items: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """Runs of numbers that count up by one (by two over a page that lacks its number), far enough apart; the longest first.

        Runs, and single numbers, are joined over pages that lack theirs, where the difference of the numbers is the
        distance in pages of the run's own length. Each number is in one run.
        """
        ends: dict[int, tuple[int, int, tuple | None, int]] = {}  # number -> length, line, the one before
        entries = []
        for i, n in items:
            before = None
            for step in (1, 2):
                x = ends.get(n - step)
                if x and i - x[1] >= APART and (before is None or x[0] > before[0]):
                    before = x
            entry = (1 + (before[0] if before else 0), i, before, n)
            entries.append(entry)
            if n not in ends or entry[0] >= ends[n][0]:
                ends[n] = entry
        runs, taken = [], set()
        for entry in sorted(entries, key=lambda e: -e[0]):  # of equals the first: sorting keeps the order
            run = []
            while entry and entry[1] not in taken:
                taken.add(entry[1])
                run.append((entry[1], entry[3]))
                entry = entry[2]
            if run:
                runs.append(run[::-1])
        runs.sort(key=lambda r: -len(r))
        first, free = np.array([r[0] for r in runs], dtype=np.int64).reshape(-1, 2), np.ones(len(runs), dtype=bool)
        last = np.array([r[-1] for r in runs], dtype=np.int64).reshape(-1, 2)
        single = np.array([len(r) == 1 for r in runs])
        lengths = np.array([_page_length(r) or 0.0 for r in runs])
        joined = []
        for k, run in enumerate(runs):
            if not free[k]:
                continue
            free[k] = False
            length = lengths[k]
            while length:
                # behind, then before: the nearest that fits
                for at, sign, (line, number) in ((first, 1, run[-1]), (last, -1, run[0])):
                    gap, step = sign * (at[:, 0] - line), sign * (at[:, 1] - number)
                    off = np.abs(gap / length - step)
                    fits = free & (step >= 1) & (gap >= APART) & np.where(single, off <= 0.4 + 0.1 * step, (off <= 1 + 0.25 * step) & (lengths >= 0.5 * length) & (lengths <= 2 * length))
                    if fits.any():
                        j = int(np.flatnonzero(fits)[np.argmin(gap[fits])])
                        free[j] = False
                        run = run + runs[j] if sign > 0 else runs[j] + run
                        break
                else:
                    break
            joined.append(run)
        return sorted(joined, key=lambda r: -len(r))

    @staticmethod
    def _part(pages: set[int]) -> bool:
        """Whether four successive pages, or four successive left or right ones, are among these."""
        return any(all(p + step * k in pages for k in range(4)) for p in pages for step in (1, 2))

    def _recurring(self, same: list[int], edges: dict[int, int]) -> set[int]:
        """Lines of one key that a page near to theirs has too, at the same one of its edges."""
        bounds: dict[int, tuple[int, int]] = {}
        for i, p in edges.items():
            low, high = bounds.get(p, (i, i))
            bounds[p] = min(low, i), max(high, i)
        sides: dict[bool, list[int]] = {}
        for i in same:
            low, high = bounds[edges[i]]
            sides.setdefault(i - low <= high - i, []).append(i)
        return {i for on in sides.values() for i in on if any(0 < abs(edges[i] - edges[j]) <= NEARBY for j in on)}

    def at_edge(self, same: list[int], edges: dict[int, int], numbers: set[int]) -> bool:
        """Whether lines of one key stand where a head or foot does, page after page of this file.

        Where pages are known, that is in one place from their top or bottom, page numbers not counted, on most pages, on
        all left or all right ones, or on four that follow one another. Else it is beside page numbers or at the file's ends, more often than not, and
        beside half of the numbers; without numbers, at even distances from end to end.
        """
        if edges:
            lines: dict[int, list[int]] = {}
            for i in self.full:
                if self.pages[i] is not None and i not in numbers:
                    lines.setdefault(self.pages[i], []).append(i)
            wanted, places = set(same), {}
            for page, on in lines.items():
                for k, i in enumerate(on):
                    if i in wanted:
                        places.setdefault(k, set()).add(page)
                        places.setdefault(k - len(on), set()).add(page)
            n = len(set(edges.values()))
            if any(-3 <= k < 3 and self._part(p) for k, p in places.items()):
                return True
            return any(-3 <= k < 3 and len(p) >= 2 and (len(p) * 2 > n or (len(p) >= 3 and len(p) * 2 >= n - 1 and len({x % 2 for x in p}) == 1)) for k, p in places.items())
        place = {i: k for k, i in enumerate(self.full)}
        sides = max(sum(1 for i in same if 0 <= place[i] + d < len(self.full) and self.full[place[i] + d] in numbers) for d in (-1, 1))
        if numbers:
            sides += sides and sum(1 for i in same if place[i] in (0, len(self.full) - 1))
            return len(same) >= 2 and sides * 2 > len(same) and sides * 2 >= len(numbers)
        gaps = [b - a for a, b in zip(same, same[1:], strict=False)]
        return len(same) >= 4 and min(gaps) >= APART and max(gaps) <= 1.5 * min(gaps) and same[0] <= max(gaps) and len(self.texts) - same[-1] <= 1.5 * max(gaps)

    def find_furniture(self, common: set[str]) -> None:
        """common: keys of lines that many files have: headings of sections, unless they stand at this file's page edges."""
        numbers = self.numbers()
        out = set(numbers)
        edges = self.edges()
        keys = {i: head_key(self.texts[i]) for i in self.full if headlike(self.texts[i]) and i not in numbers or (i in numbers and (page_form(self.texts[i]) or ("", 0, ""))[2])}
        place = {i: k for k, i in enumerate(self.full)}
        seeds: dict[str, int] = {}
        if edges:
            for i in sorted(edges):
                if i in keys:
                    seeds.setdefault(keys[i], i)
        else:
            near = [*self.full[:2], *self.full[-1:]]
            near += [self.full[k] for i in numbers for k in (place[i] - 1, place[i] + 1, place[i] + 2) if 0 <= k < len(self.full)]
            counts = Counter(keys.values())
            for i in [*near, *[i for i in keys if counts[keys[i]] >= 3]]:
                if i in keys:
                    seeds.setdefault(keys[i], i)
        for seed in seeds:
            if len(seed) < 4:
                continue
            if seed in common:
                same = [i for i, k in keys.items() if k == seed or alike(k, seed)]
                if self.at_edge(same, edges, numbers):
                    out |= {i for i in same if not edges or i in edges}
                continue
            same = [i for i, k in keys.items() if k == seed or (k not in common and alike(k, seed))]
            if edges:
                pages = {edges[i] for i in same if i in edges}
                if len(pages) >= 2 and len(pages) * 4 >= len(set(edges.values())):
                    out |= {i for i in same if i in edges}
                else:  # a head of one part of the file recurs from page to page there
                    out |= self._recurring([i for i in same if i in edges], edges)
            elif len(same) >= 2 and all(b - a >= APART for a, b in zip(same, same[1:], strict=False)):
                out |= set(same)
        # text with a number beside it, right behind or before a page number
        for i in self.full:
            if i not in out and (found := page_form(self.texts[i])) and found[2] and any(self.full[k] in numbers for k in (place[i] - 1, place[i] + 1) if 0 <= k < len(self.full)):
                out.add(i)
        self.furniture = out

    def body(self) -> list[int]:
        return [i for i in self.full if i not in self.furniture and i not in self.aside]

    def asks(self, common: dict[str, int]) -> set[str]:
        """Words, and joined words, that the vocabulary must be asked for."""
        out: set[str] = set()
        body, usual = self.body(), common.__contains__
        for k, i in enumerate(body):
            line = self.texts[i].strip()
            terms = WORD.findall(line.lower())
            odd = [] if all(map(usual, terms)) else [w for w in terms if w not in common and not w.isdigit()]
            out.update(odd)
            out.update(x for w in odd for x in parted(w))
            if odd:
                out.update(a + b for a, b in zip(terms, terms[1:], strict=False) if (a not in common or b not in common) and not (a + b).isdigit())
            following = FIRST.match(self.texts[body[k + 1]].strip()) if k + 1 < len(body) else None
            if following and (cut := CUT.search(line)):
                stem, rest = cut[1].lower(), following[1].lower()
                last = stem.rsplit("-", 1)[-1]
                out |= {last + rest, f"{stem}-{rest}", f"{last}-"}
            elif following and odd and terms and terms[-1] == odd[-1]:
                out.add(terms[-1] + following[1].lower())
        return out

    def defects(self, known: dict[str, tuple[int, str | None]], common: dict[str, int]) -> tuple[list[tuple[int, str]], list[str]]:
        """Defects by line, and the repaired paragraphs. known: count of a word, and the word it may be a misreading of."""
        found: set[tuple[int, str]] = {(i, "furniture") for i in self.furniture}

        def count(w: str) -> int:
            return common[w] if w in common else known.get(w, (0, None))[0]

        def meant(w: str) -> str | None:
            if count(w):
                return None
            return known.get(w, (0, None))[1] or next((x for x in parted(w) if count(x)), None)

        body, skip = self.body(), {}

        def usual(w: str) -> bool:
            return w in common or w.isdigit() or (w in known and known[w][0] > 0)

        texts = {i: self.texts[i].strip() for i in body}
        glued: dict[int, str] = {}
        for k, i in enumerate(body[:-1]):
            after = body[k + 1]
            first = FIRST.match(texts[after])
            cut = CUT.search(texts[i])
            if not first:
                continue
            rest = first[1].lower()
            if cut:
                stem, last = cut[1].lower(), cut[1].lower().rsplit("-", 1)[-1]
                joined, compound = last + rest, f"{stem}-{rest}"
                own_hyphen = cut[2] == "-" and not count(joined) and not meant(joined) and (count(compound) or known.get(f"{last}-", (0, None))[0])
                if own_hyphen or (cut[2] == "-" and count(compound) > count(joined) * 20):
                    glued[i] = "-"
                    continue
                found.add((i, "broken_word"))
                glued[i] = ""
                skip[i, "last"] = skip[after, "first"] = True
                if word := meant(joined):
                    misread_first = word[: len(last)] != last
                    found.add((i if misread_first else after, "misread"))
                    if misread_first and not word.endswith(rest):
                        found.add((after, "misread"))
            else:
                terms = WORD.findall(texts[i])
                if terms and texts[i].endswith(terms[-1]) and first[1].islower():
                    last = terms[-1].lower()
                    if count(last + rest) and not count(last) and not count(rest) and len(last + rest) > 3:
                        found.add((i, "broken_word"))
                        glued[i] = ""
                        skip[i, "last"] = skip[after, "first"] = True
        repaired: dict[int, str] = {}
        for i in body:
            line = texts[i]
            if all(map(usual, WORD.findall(line.lower()))):  # no word is in doubt
                repaired[i] = line
                continue
            spans = list(WORD.finditer(line))
            terms = [m[0].lower() for m in spans]
            fixes: list[tuple[int, int, str]] = []
            k = 0
            while k < len(spans):
                w = terms[k]
                if (k == 0 and (i, "first") in skip) or (k == len(spans) - 1 and (i, "last") in skip):
                    k += 1
                    continue
                if k + 1 < len(spans) and line[spans[k].end() : spans[k + 1].start()] == " " and not ((k + 2 == len(spans)) and (i, "last") in skip):
                    joined = w + terms[k + 1]
                    a, b, j = count(w), count(terms[k + 1]), count(joined)
                    alpha = w.isalpha() and terms[k + 1].isalpha() and spans[k + 1][0].islower()
                    if alpha and len(joined) > 2 and (j and (not a or not b) or (not j and not a and not b and not meant(w) and not meant(terms[k + 1]) and meant(joined))):
                        found.add((i, "misread"))
                        fixes.append((spans[k].start(), spans[k + 1].end(), _cased(spans[k][0], joined if j else meant(joined))))
                        k += 2
                        continue
                if not w.isdigit() and len(w) > 1 and (word := meant(w)):
                    found.add((i, "misread"))
                    fixes.append((spans[k].start(), spans[k].end(), _cased(spans[k][0], word)))
                k += 1
            for a, b, word in reversed(fixes):
                line = line[:a] + word + line[b:]
            repaired[i] = line
        paragraphs, open_ = [], ""
        for k, i in enumerate(body):
            new = k == 0 or (any(not self.texts[x].strip() and self.pages[x] == self.pages[i] for x in range(body[k - 1] + 1, i)) and body[k - 1] not in glued and not any(x in self.furniture for x in range(body[k - 1] + 1, i)))
            if new and open_:
                paragraphs.append(open_)
                open_ = ""
            if not open_:
                open_ = repaired[i]
            elif body[k - 1] in glued:
                open_ = (open_.rstrip(HYPHENS) + glued[body[k - 1]]) + repaired[i]
            else:
                open_ = f"{open_} {repaired[i]}"
        if open_:
            paragraphs.append(open_)
        return sorted(found), paragraphs


def _cased(seen: str, word: str | None) -> str:
    word = word or seen
    return word.upper() if len(seen) > 1 and seen.isupper() else word.capitalize() if seen[0].isupper() else word


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words, compounds and, with a hyphen behind them, first parts of compounds, counted in each batch."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch["text"]:
            if text:
                counts.update(TERM.findall(text.lower()))
        for term, n in list(counts.items()):
            if "-" in term:
                parts = term.split("-")
                counts.update({p: n for p in parts})
                counts[parts[0] + "-"] += n
        kept = [(t, n) for t, n in counts.items() if not t.isdigit()]
        if kept:
            yield pd.DataFrame({"word": [t for t, _ in kept], "n": [n for _, n in kept]})


def _unit(row) -> tuple[Unit, list[str], list[int]]:
    texts, pages, records, lines, aside = [], [], [], [], set()
    for part in row.parts:
        start = len(texts)
        for n, line in enumerate(part["text"].split("\n")):
            texts.append(line.translate(PLAIN) if not line.isascii() and OTHER_DIRT.search(line) else line)
            pages.append(None if row.source_table == "parsed_pdfs" else part["page"] if part["page"] is not None else 0)
            records.append(part["record_id"] if part["own"] else "")
            lines.append(n)
        if row.source_table != "parsed_pdfs":  # blocks stand apart
            texts.append("")
            pages.append(pages[-1])
            records.append("")
            lines.append(-1)
        if part["aside"]:
            aside.update(range(start, len(texts)))
    return Unit(texts, pages, aside), records, lines


PARTS = "array<struct<seq:bigint,page:bigint,record_id:string,text:string,own:boolean,aside:boolean>>"


def scanned_units(pdfs: DataFrame | None, blocks: DataFrame | None, pages: int = 256) -> DataFrame:
    """source_table, unit, parts: a file's text, or up to pages pages of blocks and, for context, the page behind them.

    So no task holds more of a file's blocks than that. The 2 * NEARBY pages on either side come along, set aside, for
    the heads and numbers that go on over the cut. Repeated rows count once; null texts are left out.
    """
    out = None
    if pdfs is not None:
        rows = pdfs.where("text is not null and doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
        part = F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("page"), F.col("doc_id").cast("string").alias("record_id"), F.col("text"), F.lit(True).alias("own"), F.lit(False).alias("aside"))
        out = rows.select(F.lit("parsed_pdfs").alias("source_table"), F.col("doc_id").cast("string").alias("unit"), F.array(part).cast(PARTS).alias("parts"))
    if blocks is not None:
        rows = blocks.where("text is not null and block_id is not null").select("block_id", "doc_id", "block_index", "page_number", "text").dropDuplicates(["block_id"])
        page = F.coalesce("page_number", F.lit(0))
        stretch = F.floor(page / pages)
        around = F.sequence(F.greatest(F.floor((page - 2 * NEARBY) / pages), F.least(stretch, F.lit(0))), F.floor((page + 2 * NEARBY) / pages))
        at = F.transform(around, lambda s: F.struct(s.alias("s"), (s == stretch).alias("own"), ((s != stretch) & (page != (s + 1) * pages)).alias("aside")))
        rows = rows.withColumn("at", F.explode(at))
        part = F.struct(F.coalesce("block_index", F.lit(0)).alias("seq"), F.col("page_number").alias("page"), F.col("block_id").alias("record_id"), "text", F.col("at.own").alias("own"), F.col("at.aside").alias("aside"))
        grouped = rows.groupBy("doc_id", F.col("at.s").alias("s")).agg(F.array_sort(F.collect_list(part)).cast(PARTS).alias("parts")).where(F.exists("parts", lambda x: x["own"]))
        grouped = grouped.select(F.lit("document_blocks").alias("source_table"), F.concat_ws(":", F.col("doc_id").cast("string"), "s").alias("unit"), "parts")
        out = grouped if out is None else out.union(grouped)
    if out is None:
        raise ValueError("neither pdfs nor blocks")
    return out


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples():
            unit, _, _ = _unit(row)
            keys = {head_key(unit.texts[i]) for i in unit.full if i not in unit.aside and headlike(unit.texts[i]) and len(unit.texts[i].split()) <= 6}
            rows += [(row.source_table, row.unit, k) for k in keys]
        if rows:
            yield pd.DataFrame(rows, columns=["source_table", "unit", "key"])


def repair_scans(pdfs: DataFrame | None, blocks: DataFrame | None, corpus: DataFrame, common_words: int = 20_000, head_share: float = 0.02) -> DataFrame:
    """source_table, unit, defects array<struct<record_id, line_no, defect>>, paragraphs array<string>.

    pdfs has doc_id and text, its pages one after another, lines ended by a line feed; blocks has block_id, doc_id,
    block_index, page_number and text; corpus has text, and supplies the vocabulary. Other columns are ignored.

    - furniture: the line holds only a running head or foot or a page number. A line that more than head_share of all
      units (and more than two) have is a section's heading, however often it recurs in one, unless it stands at the
      same edge of a file's pages, or beside their numbers (Unit.at_edge).
    - broken_word: the line's last word goes on in the next line of body text, over page and block if need be; a
      compound parted at its own hyphen is none.
    - misread: a line of body text has a word with wrong characters, or one that was torn apart.

    Null and empty texts have no defects. The common_words commonest words are sent to all tasks and the lists of
    common lines too, which bounds both (some MB); other words are looked up where the vocabulary lies.
    """
    spark = corpus.sparkSession
    units = materialise(scanned_units(pdfs, blocks), "units")
    terms = corpus.select(F.col("text").cast("string").alias("text")).mapInPandas(_count_terms, "word string, n bigint")
    vocabulary = materialise(terms.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    common = spark.sparkContext.broadcast({r.word: r.n for r in vocabulary.orderBy(F.desc("n"), "word").limit(common_words).collect()})
    lines = units.mapInPandas(_heads, "source_table string, unit string, key string")
    most = max(2, int(units.where("source_table = 'parsed_pdfs'").count() * head_share), int(units.where("source_table = 'document_blocks'").count() * head_share / 4))
    shared = lines.groupBy("source_table", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).groupBy("key").agg(F.max("n").alias("n"))
    # a line counts once a unit, so no more than 1 / head_share times a unit's mean number of such lines exceed the share
    headings = spark.sparkContext.broadcast({r.key for r in shared.select("key").collect()})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                unit, _, _ = _unit(row)
                unit.find_furniture(headings.value)
                rows.append((row.source_table, row.unit, None, sorted(unit.furniture)))
                rows += [(row.source_table, row.unit, w, None) for w in unit.asks(common.value)]
            if rows:
                yield pd.DataFrame(rows, columns=["source_table", "unit", "word", "furniture"])

    seen = materialise(units.mapInPandas(ask, "source_table string, unit string, word string, furniture array<int>"), "asked")
    asked = seen.where("word is not null").drop("furniture")

    def with_skeleton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["skeleton"] = [skeleton(w) for w in batch["word"]]
            yield batch

    words = vocabulary.where("not endswith(word, '-') and not contains(word, '-') and length(word) > 2").mapInPandas(with_skeleton, "word string, n bigint, skeleton string")
    shapes = words.groupBy("skeleton").agg(F.max_by("word", F.struct("n", "word")).alias("meant"))
    distinct = asked.select("word").distinct().join(vocabulary, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    absent = distinct.where("n = 0 and length(word) > 2").mapInPandas(with_skeleton, "word string, n bigint, skeleton string").join(shapes, "skeleton")
    answers = distinct.where("n > 0").select("word", "n", F.lit(None).cast("string").alias("meant")).union(absent.select("word", "n", "meant"))
    told = asked.join(answers, "word").groupBy("source_table", "unit").agg(F.collect_list(F.struct("word", "n", "meant")).alias("answers"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                unit, records, numbers = _unit(row)
                unit.furniture = set(row.furniture)
                known = {a["word"]: (a["n"], a["meant"]) for a in row.answers} if row.answers is not None else {}
                found, paragraphs = unit.defects(known, common.value)
                rows.append((row.source_table, row.unit, [{"record_id": records[i], "line_no": numbers[i], "defect": x} for i, x in found if records[i]], paragraphs))
            if rows:
                yield pd.DataFrame(rows, columns=["source_table", "unit", "defects", "paragraphs"])

    schema = "source_table string, unit string, defects array<struct<record_id:string,line_no:bigint,defect:string>>, paragraphs array<string>"
    lines = seen.where("word is null").select("source_table", "unit", "furniture")
    return units.join(lines, ["source_table", "unit"]).join(told, ["source_table", "unit"], "left").mapInPandas(decide, schema)
