"""Text as column expressions: token estimates, units, chunk folds, term sets, labels. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that queries and term sets leave out.
QUERY_STOPWORDS = ("a", "an", "and", "are", "as", "at", "best", "for", "from", "how", "i", "in", "is", "it", "amount", "day", "me", "my", "of", "on", "or", "show", "the", "to", "what", "when", "which", "with")
#: a word: letters of any script, digits, underscores
WORDS = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[.!?])\s+|\n+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. Inside a fold or a lambda Spark evaluates a repeated expression each time
    it stands; as the only element of an array it is evaluated when the array is made."""
    return F.transform(F.array(value), body)[0]


def word_tokens(text: Column) -> Column:
    """Runs of non-blanks, at least 1: the estimate that chunking uses."""
    return F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1))


def char_tokens(text: Column) -> Column:
    """A token for every four characters begun, at least 1: the estimate that prompts use."""
    return F.greatest(F.floor((F.char_length(text) + 3) / 4).cast("int"), F.lit(1))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def split_sentences(text: Column) -> Column:
    return _trimmed(F.split(text, SENTENCE_END))


def looks_like_rows(lines: Column) -> Column:
    """Whether lines are records: at least half of them, and two, hold a digit and a separator."""
    row = F.filter(lines, lambda x: x.rlike(r"\d") & (x.rlike(r"[,\t/]") | x.rlike(r"\s\d")))
    return F.size(row) >= F.greatest(F.lit(2), F.floor(F.size(lines) / 2))


def text_units(text: Column) -> Column:
    """Lines of record blocks, sentences of the others; blocks are parted by blank lines."""

    def of_block(block: Column) -> Column:
        lines = _trimmed(F.split(block, r"\n"))
        return F.when((F.size(lines) > 1) & looks_like_rows(lines), lines).otherwise(split_sentences(block))

    return F.flatten(F.transform(_trimmed(F.split(text, r"\n\s*\n")), of_block))


def bounded_units(units: Column, most: Column | int) -> Column:
    """Units of more than most words cut into runs of that many; the others as they are."""
    most = most if isinstance(most, Column) else F.lit(most)

    def cut(unit: Column) -> Column:
        words = F.split(F.trim(unit), r"\s+")
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / most).cast("int") - 1, F.lit(0)))
        pieces = F.transform(starts, lambda i: F.array_join(F.slice(words, i * most + 1, most), " "))
        return F.when(F.size(words) > most, pieces).otherwise(F.array(unit))

    return F.flatten(F.transform(units, cut))


def _pack(units: Column, target: Column, most: Column, glue: str, overlap: Column) -> Column:
    """Units packed in order: a chunk closes before a unit that would exceed most, and once it has target words.

    The last words of a closed chunk, as many as overlap, open the next one; a chunk of nothing else stays in."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))

    def tail(text: Column) -> Column:
        words = F.split(F.trim(text), r"\s+")
        kept = F.slice(words, F.greatest(F.size(words) - overlap + 1, F.lit(1)), F.greatest(overlap, F.lit(1)))
        return F.when((overlap > 0) & (F.trim(text) != ""), F.array_join(kept, " ")).otherwise(F.lit(""))

    def count(text: Column) -> Column:
        return F.regexp_count(text, F.lit(r"\S+"))

    def step(a: Column, unit: Column) -> Column:
        def with_size(s: Column) -> Column:
            full = (a["text"] != "") & (a["n"] + s > most)
            return let(F.struct(full.alias("full"), F.when(full, tail(a["text"])).otherwise(a["text"]).alias("text")), lambda o: opened(s, o))

        def opened(s: Column, o: Column) -> Column:
            text = F.when(o["text"] == "", unit).otherwise(F.concat(o["text"], F.lit(glue), unit))
            n = F.when(o["full"], count(o["text"])).otherwise(a["n"]) + s
            done = F.when(o["full"], F.array_append(a["done"], a["text"])).otherwise(a["done"])
            return let(F.struct(text.alias("text"), n.alias("n"), done.alias("done")), packed)

        def packed(p: Column) -> Column:
            closed = let(tail(p["text"]), lambda t: F.struct(F.array_append(p["done"], p["text"]).alias("done"), t.alias("text"), count(t).cast("int").alias("n")))
            return F.when(p["n"] >= target, closed).otherwise(F.struct(p["done"].alias("done"), p["text"].alias("text"), p["n"].cast("int").alias("n")))

        return let(word_tokens(unit), with_size)

    return F.aggregate(units, start, step, lambda a: F.when(a["text"] != "", F.array_append(a["done"], a["text"])).otherwise(a["done"]))


def parent_chunks(text: Column, target: Column | int = 520, most: Column | int = 650) -> Column:
    """Parents of a text: units joined by line feeds. Null gives null, a text without units an empty array."""
    target, most = (x if isinstance(x, Column) else F.lit(x) for x in (target, most))
    return _pack(bounded_units(text_units(text), most), F.least(target, most), most, "\n", F.lit(0))


def child_chunks(text: Column, target: Column | int = 110, most: Column | int = 150, overlap: Column | int = 0) -> Column:
    """Children of a parent: units joined by spaces, each opened by the last overlap words of the one before."""
    target, most, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (target, most, overlap))
    return _pack(bounded_units(text_units(text), most), F.least(target, most), most, " ", overlap)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), F.lit(1))


def term_set(text: Column, stopwords: Iterable[str] = QUERY_STOPWORDS, least: int = 3, pattern: str = WORDS) -> Column:
    """Distinct lower-case words of at least least characters, in order, without stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))
    stop = list(stopwords)
    kept = F.filter(words, lambda x: (F.char_length(x) >= least) & ~(x.isin(*stop) if stop else F.lit(False)))
    return F.array_distinct(kept)


def term_root(term: Column) -> Column:
    """A word of letters cut to six."""
    return F.when((F.char_length(term) > 6) & term.rlike(r"^\p{L}+$"), F.substring(term, 1, 6)).otherwise(term)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common terms among all; 0 where either side has none."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / union)


def containment(part: Column, whole: Column) -> Column:
    """Share of part's terms that whole has; 0 where part has none."""
    return F.when(F.size(part) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def search_terms(prompt: Column, most: int = 24) -> Column:
    """Terms of a lexical query: words of three characters or more, and those without a plural's s, up to most."""
    words = F.filter(words_of(prompt), lambda x: (F.char_length(x) >= 3) & ~x.isin(*QUERY_STOPWORDS))
    both = F.flatten(F.transform(words, lambda x: F.when(x.endswith("s") & (F.char_length(x) > 4), F.array(x, F.substring(x, 1, F.char_length(x) - 1))).otherwise(F.array(x))))
    return F.slice(F.array_distinct(both), 1, most)


def subqueries(prompt: Column) -> Column:
    """array<struct<id, text>>: the whole prompt first, then up to five parts of at least two terms each.

    Parts are parted by conjunctions, comparisons, question marks and semicolons; instructions on the form of the
    answer are no parts. A prompt that has no two parts is "q1" by itself, one without two useful ones "q0"."""
    clean = squeeze(prompt)
    parts = F.filter(F.transform(F.split(clean, r"(?i)\b(?:and|also|versus|vs\.?|compare)\b|[?;]"), lambda x: F.regexp_replace(x, r"^[ ,;]+|[ ,;]+$", "")), lambda x: x != "")
    useful = F.filter(parts, lambda x: ~F.lower(x).rlike(r"^(?:cite|include|use|answer|respond|format)\b") & (F.size(F.filter(words_of(x), lambda w: (F.char_length(w) >= 3) & ~w.isin(*QUERY_STOPWORDS))) >= 2))
    named = F.transform(F.slice(useful, 1, 5), lambda x, i: F.struct(F.concat(F.lit("q"), (i + 1).cast("string")).alias("id"), x.alias("text")))
    whole = F.array(F.struct(F.lit("q0").alias("id"), clean.alias("text")))
    alone = F.array(F.struct(F.lit("q1").alias("id"), clean.alias("text")))
    return F.when(F.size(parts) <= 1, alone).when(F.size(useful) <= 1, whole).otherwise(F.concat(whole, named))


def context_blocks(text: Column) -> Column:
    """array<struct<kind, text>>: fenced, tabular and list blocks whole, sentences of the others."""

    def of_block(block: Column) -> Column:
        lines = F.filter(F.split(block, r"\n"), lambda x: F.trim(x) != "")
        listed = F.forall(lines, lambda x: x.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+"))
        structured = block.startswith("```") | F.exists(lines, lambda x: x.contains("\t") | x.contains("|")) | listed
        return F.when(structured, F.array(F.struct(F.lit("structured").alias("kind"), block.alias("text")))).otherwise(F.transform(split_sentences(block), lambda s: F.struct(F.lit("prose").alias("kind"), s.alias("text"))))

    return F.flatten(F.transform(_trimmed(F.split(text, r"\n\s*\n")), of_block))


def strip_hidden(text: Column) -> Column:
    """A text without what stands between think tags, unclosed ones too."""
    return F.trim(F.regexp_replace(text, r"(?is)<think\b[^>]*>.*?(?:</think\s*>|$)", ""))


def normalised_header(header: Column, index: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.lower(header), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("column_"), (index + 1).cast("string"))).otherwise(name)


def truncated(text: Column, most: Column | int) -> Column:
    """Blanks squeezed, cut at the last blank within most characters, without punctuation left at the end."""
    most = most if isinstance(most, Column) else F.lit(most)

    def cut(clean: Column) -> Column:
        head = F.substring(clean, F.lit(1), most + 1)
        # where the last blank is, or 0
        at = F.when(F.instr(head, " ") == 0, 0).otherwise(F.char_length(head) - F.instr(F.reverse(head), " "))
        kept = F.substring(clean, F.lit(1), F.when(at > 0, at).otherwise(most))
        return F.when(F.char_length(clean) <= most, clean).otherwise(F.regexp_replace(kept, r"[ ,;:-]+$", ""))

    return let(squeeze(text), cut)


def contextual_text(text: Column, title: Column, section: Column, page: Column, page_end: Column, block_type: Column) -> Column:
    """What is embedded for a chunk: document, section, page and kind above its text."""
    pages = F.when(page_end.isNotNull() & (page_end != page), F.concat_ws("-", page.cast("string"), page_end.cast("string"))).otherwise(page.cast("string"))
    head = F.concat_ws("\n", F.concat(F.lit("Document: "), title), F.concat(F.lit("Section: "), F.nullif(section, F.lit(""))), F.concat(F.lit("Page: "), pages), F.concat(F.lit("Block type: "), block_type))
    return F.concat(head, F.lit("\n\n"), F.trim(text))


def source_context(source_id: Column, name: Column, chunk_id: Column, text: Column) -> Column:
    return F.concat(F.lit("[[src:"), source_id, F.lit("]] Source: "), name, F.lit(" | Chunk: "), chunk_id, F.lit("\n"), F.trim(text))


def location_label(page: Column, page_end: Column, section: Column) -> Column:
    pages = F.when(page_end.isNotNull() & (page_end != page), F.concat(F.lit("pp. "), page.cast("string"), F.lit("-"), page_end.cast("string"))).when(page.isNotNull(), F.concat(F.lit("p. "), page.cast("string")))
    return F.concat_ws(" · ", pages, F.nullif(section, F.lit("")))


def stable_id(kind: str, *parts: Column) -> Column:
    """kind- and 24 hex digits of the SHA-256 of the parts as a JSON array of strings."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 24))


def cited_ids(text: Column) -> Column:
    """Ids of sources that a text cites as [[src:id]], upper case, in the order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[\[src:\s*([A-Za-z0-9_-]+)\s*\]\]"), F.lit(1)), F.upper))
