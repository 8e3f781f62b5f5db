"""Splitting oversized items at natural boundaries, with the JVM's regular expressions and array functions.

A text is parted once into its tokens, and a digit for each says how strong the boundary behind it is: blank line 5,
line end 4, sentence end 3, clause end 2, blank 1; 0 is none, as inside of a word where sizes are in characters. The
string of these digits is what the pattern of bounded quantifiers runs over: each of its alternatives consumes up to
the limit and ends at a boundary, the strongest first, and the last one takes whatever fits. Every atom is one
character, so Java matches runs of any length in a loop, not by recursion, and each digit is looked at a bounded number
of times. Overlap is a lookback: a piece starts that many units before its core, and cores are shorter by as many, so
that no piece exceeds the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import let

BLANKS = " \t\n\r"
#: A token is a run of characters other than space, tab, line feed and carriage return; blanks behind it go with it.
TOKENS = {"tokens": r"[^ \t\n\r]++[ \t\n\r]*+", "chars": r"[ \t\n\r]*+[^ \t\n\r]++[ \t\n\r]*+|[ \t\n\r]++"}
CLOSERS = "\"”’)]"
SENTENCE, CLAUSE = (".", "!", "?", "…"), (",", ";", ":", "–", "—")
STRENGTHS = "54321"
PIECE = "struct<piece_index:int,start:int,size:int,overlap:int,text:string>"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+"))


def size_of(text: Column, unit: str) -> Column:
    return token_count(text) if unit == "tokens" else F.char_length(text)


def strength(token: Column) -> Column:
    """The digit of the boundary behind a token and its blanks."""
    word = F.rtrim(token, F.lit(BLANKS))
    last, inner = F.right(word, F.lit(1)), F.right(F.rtrim(word, F.lit(CLOSERS)), F.lit(1))
    lines = F.char_length(token) - F.char_length(F.replace(token, F.lit("\n"), F.lit("")))
    return F.when(lines > 1, "5").when(lines == 1, "4").when(word == token, "0").when(inner.isin(*SENTENCE), "3").when(last.isin(*CLAUSE), "2").otherwise("1")


def core_pattern(limit: Column, least: Column) -> Column:
    """A pattern whose matches are runs of at most limit digits; least: units that a piece cut at a boundary must have."""
    at_most = F.concat(F.lit(".{1,"), limit.cast("string"), F.lit("}"))
    run = F.concat(F.lit(".{"), (least - 1).cast("string"), F.lit(","), (limit - 1).cast("string"), F.lit("}"))
    # what is left fits: it is taken whole, before any boundary in it is looked for
    return F.concat_ws("|", F.concat(at_most, F.lit(r"\z")), *[F.concat(run, F.lit(s)) for s in STRENGTHS], at_most)


def split_pieces(text: Column, limit: Column, overlap: Column, unit: str = "tokens", min_fill: float = 0.5) -> Column:
    """array<struct<piece_index, start, size, overlap, text>> of a text; start, size and overlap in units.

    A text within the limit is one piece, exactly itself, an empty one too. Null text or limit gives null. overlap is
    cut to limit - 1; null means 0. A limit below 1 counts as 1. The cores joined are the text, in tokens without its
    outer blanks, so nothing is lost; min_fill is the share of a core that a cut at a boundary must fill.
    """
    known, limit = limit.isNotNull(), F.greatest(limit, F.lit(1)).cast("int")
    overlap = F.least(F.greatest(F.coalesce(overlap, F.lit(0)), F.lit(0)), limit - 1).cast("int")
    core = limit - overlap
    least = F.greatest(F.floor(core * min_fill), F.lit(1)).cast("int")

    def of_tokens(tokens: Column) -> Column:
        if unit == "tokens":
            digits = F.array_join(F.transform(tokens, strength), "")
        else:
            digits = F.array_join(F.transform(tokens, lambda x: F.concat(F.repeat(F.lit("0"), F.char_length(x) - 1), strength(x))), "")
        sizes = F.transform(F.regexp_extract_all(digits, core_pattern(core, least), F.lit(0)), lambda x: F.char_length(x))
        # the fold's state is the ends of the cores so far
        ends = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        return let(ends, lambda e: F.transform(F.slice(e, 2, F.size(e) - 1), lambda end, i: piece(tokens, F.get(e, i), end, i)))

    def piece(tokens: Column, begin: Column, end: Column, i: Column) -> Column:
        start = F.greatest(begin - overlap, F.lit(0))
        said = F.rtrim(F.array_join(F.slice(tokens, start + 1, end - start), ""), F.lit(BLANKS)) if unit == "tokens" else F.substring(text, start + 1, end - start)
        return F.struct(i.alias("piece_index"), start.alias("start"), (end - start).alias("size"), (begin - start).alias("overlap"), said.alias("text"))

    pieces = let(F.regexp_extract_all(text, F.lit(TOKENS[unit]), F.lit(0)), of_tokens)
    n = size_of(text, unit)
    whole = F.array(F.struct(F.lit(0).alias("piece_index"), F.lit(0).alias("start"), n.cast("int").alias("size"), F.lit(0).alias("overlap"), text.alias("text")))
    return F.when(text.isNull() | ~known, F.lit(None)).when(n <= limit, whole).otherwise(pieces).cast(f"array<{PIECE}>")


def split_oversized(items: DataFrame, settings: DataFrame, key: str, text: str = "text", profile: str = "chunking_profile", default_profile: str = "default", oversized_only: bool = False) -> DataFrame:
    """key, limit, n_tokens, pieces of every item; with oversized_only of those above the limit.

    settings has a row per profile: profile, child_max_tokens, child_overlap_tokens. It is broadcast, and must be
    small: more than 10,000 profiles are refused. A null profile means default_profile; an unknown one has no limit,
    and its items get null pieces. Repeated rows of a key give repeated rows; other columns are ignored.
    """
    limits = settings.select(F.col("profile").alias("_p"), F.col("child_max_tokens").alias("limit"), F.col("child_overlap_tokens").alias("_o"))
    if len(limits.limit(10_001).take(10_001)) > 10_000:
        raise ValueError("too many profiles to broadcast")
    rows = items.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.coalesce(F.col(profile), F.lit(default_profile)).alias("_p"))
    rows = rows.join(F.broadcast(limits), "_p", "left").withColumn("n_tokens", token_count(F.col("_t")))
    if oversized_only:
        rows = rows.where("n_tokens > limit")
    pieces = split_pieces(F.col("_t"), F.col("limit"), F.col("_o"))
    return rows.select(F.col("_k").alias(key), "limit", "n_tokens", pieces.alias("pieces"))
