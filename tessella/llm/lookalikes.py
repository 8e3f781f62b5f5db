"""Visually identical text with different characters: one consistent form, by script-aware repair.

The plain part needs the text alone: canonical composition, wide and narrow forms, ligatures, hyphens of any kind,
signs without width, kinds of blanks. Look-alike letters of other scripts are another matter, since each is right in
its own script. They are substituted in tokens of mixed script, into the token's dominant script, and only when the
result is a word of the corpus vocabulary: the tokens of one script that the texts themselves hold. A token wholly of
look-alikes from a script foreign to its text is no mixed one, yet the eye can't tell it either; it is substituted on
the same condition, and only if the corpus nowhere has it as a word of its own script. That vocabulary grows with the
corpus, so it stays distributed, and only tokens in doubt are joined with it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise

# Letters that look alike, a row per shape, in Latin, Cyrillic and Greek ("." where a script has none).
SHAPES = """
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι
J Ј .
K К Κ
M М Μ
N . Ν
O О Ο
P Р Ρ
S Ѕ .
T Т Τ
X Х Χ
Y У Υ
Z . Ζ
a а α
c с ϲ
d ԁ .
e е .
h һ .
i і ι
j ј .
k к κ
o о ο
p р ρ
q ԛ .
s ѕ .
u . υ
v ѵ ν
w ԝ .
x х χ
y у γ
"""
SCRIPTS = ("latin", "cyrillic", "greek")
#: letter -> its script's place and its look-alikes by script
LIKE: dict[str, tuple[str, ...]] = {}
for _line in SHAPES.split("\n"):
    if _row := _line.split():
        LIKE |= {c: tuple(_row) for c in _row if c != "."}

TOKEN = re.compile(r"(?:[^\W_]|[̀-ͯ])+")
FOREIGN = re.compile("[Ͱ-ԯ]")
BLANKS = re.compile(r"[^\S\n]+")
#: kinds of decomposition that leave a character's look as it is, and ligatures
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>"}


def _plain_map() -> dict[int, str]:
    out: dict[int, str] = {}
    for c in range(0x80, 0x30000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cf" or 0xFE00 <= c <= 0xFE0F or c == 0x34F:
            out[c] = ""
        elif kind == "Zs" or c == 0x85:
            out[c] = " "
        elif 0xFB00 <= c <= 0xFB06 or (d := unicodedata.decomposition(ch)) and d.split()[0] in SAME_LOOK:
            out[c] = unicodedata.normalize("NFKC", ch)
    return out | {0x2010: "-", 0x2011: "-", 0x3BC: "µ", 0x2028: "\n", 0x2029: "\n", 0x0D: ""}


PLAIN = _plain_map()


def plain_form(text: str) -> str:
    """What needs neither script nor vocabulary. Blanks at the ends of lines go, runs of them are one."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(PLAIN))
    text = BLANKS.sub(" ", text)
    return "\n".join(line.strip() for line in text.split("\n")).strip()


def script(c: str) -> int:
    """0, 1, 2 for Latin, Cyrillic, Greek; -1 for whatever has none or another."""
    n = ord(c)
    if n < 0x80:
        return 0 if c.isalpha() else -1
    if 0xC0 <= n <= 0x24F or 0x1E00 <= n <= 0x1EFF:
        return 0
    if 0x400 <= n <= 0x52F:
        return 1
    if 0x370 <= n <= 0x3FF:
        return 2
    return -1


def scripts_of(token: str) -> list[int]:
    counts = [0, 0, 0]
    for c in token:
        if (s := script(c)) >= 0:
            counts[s] += 1
    return counts


def into(token: str, target: int) -> str | None:
    """The token with all letters in the target script, or None where one has no counterpart there."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        if script(c) not in (-1, target):
            c = LIKE.get(c, ("", "", ""))[target]
            if c in ("", "."):
                return None
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def doubtful(text: str) -> dict[str, list[str]]:
    """Tokens that may hold look-alikes, each with what it may stand for, the likeliest first."""
    if not FOREIGN.search(text):
        return {}
    whole = scripts_of(text)
    main = whole.index(max(whole))
    out: dict[str, list[str]] = {}
    for token in set(TOKEN.findall(text)):
        counts = scripts_of(token)
        if len(token) == 1 and main != 0:  # a unit's or a formula's letter
            continue
        kinds = [s for s in range(3) if counts[s]]
        if len(kinds) > 1:
            exclusive = [sum(script(c) == s and c not in LIKE for c in unicodedata.normalize("NFD", token)) for s in range(3)]
            order = sorted(kinds, key=lambda s: (-counts[s], -exclusive[s], s != main))
            order += [main] * (main not in order)
        elif kinds and kinds[0] != main:
            order = [main]
        else:
            continue
        found = [f for s in order if (f := into(token, s)) is not None and f != token]
        if found:
            # a word of its own script, where the corpus has it, stays as it is
            out[token] = list(dict.fromkeys(found if len(kinds) > 1 or len(token) == 1 else [token, *found]))
    return out


def substitute(text: str, forms: dict[str, str]) -> str:
    return TOKEN.sub(lambda m: forms.get(m[0], m[0]), text)


def digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


#: tokens that a task keeps before it hands them on
HELD = 200_000


def _scan(batches: Iterator[pd.DataFrame], keep_text: bool) -> Iterator[pd.DataFrame]:
    """Rows (k, raw, form, text) and, as rows without k, the vocabulary: distinct tokens of one script."""
    held: set[str] = set()

    def words() -> pd.DataFrame:
        return pd.DataFrame({"k": None, "raw": None, "form": None, "text": sorted(held), "doubts": None})

    for batch in batches:
        rows = []
        for key, text in zip(batch["k"], batch["text"], strict=True):
            base = plain_form(text)
            doubts = doubtful(base)
            pending = [{"token": t, "place": i, "form": f} for t, fs in doubts.items() for i, f in enumerate(fs)]
            rows.append((key, digest(text), None if doubts else digest(base), base if doubts or keep_text else None, pending or None))
            held.update(t.lower() for t in TOKEN.findall(base) if t not in doubts)
        if rows:  # an empty frame has no type for its nested column
            yield pd.DataFrame(rows, columns=["k", "raw", "form", "text", "doubts"])
        if len(held) > HELD:
            yield words()
            held.clear()
    if held:
        yield words()


def _forms(rows: DataFrame, keep_text: bool) -> DataFrame:
    """k, raw (digest of the text), form (digest of its consistent form) and, if kept, the form's text."""
    schema = "k string, raw binary, form binary, text string, doubts array<struct<token:string,place:int,form:string>>"
    scanned = materialise(rows.where("text is not null").mapInPandas(lambda b: _scan(b, keep_text), schema), "forms")
    sure = scanned.where("k is not null and doubts is null").select("k", "raw", "form", "text")
    pending = scanned.where("k is not null and doubts is not null")
    asked = pending.select("k", "raw", F.explode("doubts").alias("d")).select("k", "raw", "d.*").distinct()
    vocabulary = scanned.where("k is null").select(F.col("text").alias("word")).distinct()
    known = asked.join(vocabulary, F.lower("form") == F.col("word"), "left_semi")
    chosen = known.groupBy("k", "raw", "token").agg(F.min(F.struct("place", "form")).alias("best"))
    maps = chosen.groupBy("k", "raw").agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("best.form").alias("form")))).alias("forms"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [substitute(t, dict(f)) if f is not None else t for t, f in zip(batch["text"], batch["forms"], strict=True)]
            yield pd.DataFrame({"k": batch["k"], "raw": batch["raw"], "form": [digest(t) for t in done], "text": done if keep_text else None})

    repaired = pending.select("k", "raw", "text").join(maps, ["k", "raw"], "left").mapInPandas(finish, "k string, raw binary, form binary, text string")
    return sure.union(repaired)


def consistent_forms(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key (as text), form: every text in its consistent form.

    Letter case, accents, digits, punctuation and wording stay. Null texts are left out, empty ones stay empty.
    Repeated rows give repeated rows; other columns are ignored.
    """
    rows = texts.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    return _forms(rows, True).select(F.col("k").alias(key), F.col("text").alias("form"))


def form_classes(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key (as text), form_id, n_rows, n_texts: the class of texts that look like a row's, without writing out its pairs.

    n_rows counts the class's keys, n_texts the texts among them that differ in characters. Nulls are left out;
    repeated rows count once.
    """
    rows = texts.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    forms = materialise(_forms(rows, False).select("k", "raw", F.hex("form").alias("form_id")).distinct(), "digests")
    counts = forms.groupBy("form_id", "raw").agg(F.count("*").alias("n")).groupBy("form_id").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_texts"))
    return forms.join(counts, "form_id").select(F.col("k").alias(key), "form_id", "n_rows", "n_texts").distinct()


def same_looking_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str = "text") -> DataFrame:
    """left_key, right_key (as text): rows whose whole texts have one consistent form but differ in characters.

    Pairs are sought between classes of equal texts, so many copies of one text cost a join only where another text
    looks like them. Null texts look like nothing. Repeated rows count once; other columns are ignored.
    """
    rows = left.select(F.concat(F.lit("l"), F.col(left_key).cast("string")).alias("k"), F.col(text).alias("text"))
    rows = rows.union(right.select(F.concat(F.lit("r"), F.col(right_key).cast("string")).alias("k"), F.col(text).alias("text")))
    forms = materialise(_forms(rows, False).select(F.substring("k", 1, 1).alias("side"), F.expr("substring(k, 2)").alias("k"), "raw", "form"), "digests")
    varied = forms.groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("b"), F.min("side").alias("s"), F.max("side").alias("t")).where("a <> b and s <> t")
    forms = forms.join(varied.select("form"), "form", "left_semi")
    l, r = forms.where("side = 'l'"), forms.where("side = 'r'")
    classes = l.select("form", F.col("raw").alias("a")).distinct().join(r.select("form", F.col("raw").alias("b")).distinct(), "form").where("a <> b").drop("form")
    pairs = classes.join(l.select(F.col("raw").alias("a"), F.col("k").alias(left_key)).distinct(), "a").join(r.select(F.col("raw").alias("b"), F.col("k").alias(right_key)).distinct(), "b")
    return pairs.select(left_key, right_key).distinct()
