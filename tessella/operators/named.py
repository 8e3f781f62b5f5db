"""Documents that a question names: titles in quotes, what is asked of them, which candidates are those documents, and
which of their passages can answer. Expressions over one row; only requirements meet candidates, within their query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import let, squeeze

# What makes a question one about documents, how titles are quoted, what is no title.
ABOUT = r"(?i)\b(?:target|paper|study|studies|source|synthesi[sz]|contribut|result|finding|method|approach|performance|limitation|compare)\w*\b"
QUOTED = "“([^”\\n]{2,240})”|‘([^’\\n]{2,240})’|\"([^\"\\n]{2,240})\"|'([^'\\n]{2,240})'"
UNQUOTED = r"(?i)\buse\s+(?:the\s+)?(.{2,240}?)\s+as\s+(?:the\s+)?target(?:\s+(?:paper|study|source|document))?\b"
EDGES = " \t\r\n.,;:!?()[]"
NO_TITLE = ("paper", "study", "source")
# What a question asks of a document, and the words by which a passage shows that it says so.
ASKED = {"contribution": "contribut|central finding|introduc|propos", "result": "result|achiev|performance|finding|improv|outperform", "method": "method|approach|how|pipeline|technique", "limitation": "limit|challenge|failure|drawback|caveat"}
SAID = {
    "contribution": r"(?i)\b(?:contribut\w*|introduc\w*|propos\w*|present\w*|develop\w*|design\w*|pioneer\w*|novel\w*|framework|approach)\b",
    "result": r"(?i)\b(?:result\w*|achiev\w*|improv\w*|outperform\w*|demonstrat\w*|show\w*|find\w*|measur\w*|evaluat\w*|performance|accuracy|recall|precision|report\w*|observ\w*|yield\w*|reduc\w*)\b",
    "method": r"(?i)\b(?:method\w*|approach\w*|pipeline\w*|algorithm\w*|architectur\w*|procedure\w*|technique\w*|process\w*|us(?:e|es|ed|ing)|utiliz\w*)\b",
    "limitation": r"(?i)\b(?:limit\w*|challeng\w*|fail\w*|cannot|without|drawback\w*|caveat\w*|weakness\w*|shortcoming\w*|however)\b",
}
# What a passage must have, and must not be, to count as evidence of a named document.
LEAST_WORDS, COVERED = 18, 0.34
MARKER = r"(?i)\b(?:introduc\w*|propos\w*|present\w*|develop\w*|contribut\w*|achiev\w*|improv\w*|outperform\w*|demonstrat\w*|show\w*|find\w*|result\w*|method\w*|approach\w*|experiment\w*|evaluat\w*|measur\w*|limit\w*|challeng\w*|fail\w*|cannot|however)\b"
REFERENCE_ONLY = r"(?i)^\s*(?:references?|bibliography|doi\s*[:=]|https?://|www\.|arxiv\s*[:=])\b"
CITING = r"(?i)\b(?:19|20)\d{2}\b|\bet\s+al\.?\b|\bdoi\b|\bpp?\.\b"
SUBJECT = r"(?i)\b(?:we|our|this|the\s+(?:paper|study|work|authors?))\b"
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "was", "were", "what", "when", "which", "who", "with", "versus", "vs", "compare", "explain", "describe", "paper", "study")
KINDS = ("pdf", "txt", "md")


def targets(prompt: Column) -> Column:
    """array<string>: the titles that a question about documents quotes, each once whatever its letter case; where it quotes none, the one of "use ... as the target"."""
    bare = lambda x: F.btrim(F.substring(x, F.lit(2), F.char_length(x) - 2), F.lit(EDGES))
    quoted = F.filter(F.transform(F.regexp_extract_all(prompt, F.lit(QUOTED), F.lit(0)), bare), lambda x: (F.char_length(x) >= 2) & ~F.lower(x).isin(*NO_TITLE))
    once = let(quoted, lambda q: let(F.transform(q, F.lower), lambda low: F.filter(q, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))
    plain = F.btrim(F.regexp_extract(prompt, UNQUOTED, 1), F.lit(EDGES))
    none = F.array().cast("array<string>")
    other = F.when((plain != "") & ~F.lower(plain).isin(*NO_TITLE, "document"), F.array(plain)).otherwise(none)
    return F.when(~F.coalesce(prompt.rlike(ABOUT), F.lit(False)), none).otherwise(let(once, lambda o: F.when(F.size(o) > 0, o).otherwise(other)))


def needs(prompt: Column) -> Column:
    """array<string>: which of contribution, result, method and limitation a question asks for; all of them if it says none."""
    found = F.array_compact(F.array(*[F.when(F.lower(prompt).rlike(p), n) for n, p in ASKED.items()]))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(*[F.lit(n) for n in ASKED])))


def need_coverage(wanted: Column, text: Column) -> Column:
    """The share of needs of which a passage shows a sign; 0 where nothing is needed."""
    said = F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in SAID.items()]))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, said)) / F.size(F.array_distinct(wanted))).otherwise(F.lit(0.0))


def qualifies(text: Column) -> Column:
    """Whether a passage can be evidence: long enough, a statement, and neither references nor front matter."""
    clean = squeeze(text)
    words = F.regexp_count(clean, F.lit(r"[\p{L}\p{N}_%.-]+"))
    listing = (F.regexp_count(clean, F.lit(CITING)) >= 3) & ~clean.rlike(SUBJECT)
    return (words >= LEAST_WORDS) & ~clean.rlike(REFERENCE_ONLY) & clean.rlike("[A-Za-z]{3}") & ~listing & clean.rlike(MARKER)


def _plain(name: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(name), r"\.(?:pdf|txt|md|csv|json)$", ""), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " ")


def _tokens(name: Column) -> Column:
    words = F.regexp_extract_all(F.lower(name), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(*STOPWORDS, *KINDS)))


def is_document(title: Column, names: Column) -> Column:
    """Whether one of a document's names holds the title or what stands before its colon, or shares two of its words, or its only one if that has four letters."""
    clean = squeeze(title)
    aliases = F.array_distinct(F.filter(F.array(clean, F.btrim(F.split_part(clean, F.lit(":"), F.lit(1)), F.lit(" -"))), lambda x: x != ""))
    kept = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    known = F.array_distinct(F.flatten(F.transform(kept, _tokens)))

    def matches(alias: Column) -> Column:
        own, plain = _tokens(alias), _plain(alias)
        held = (plain != "") & F.exists(kept, lambda n: _plain(n).contains(plain))
        shared = F.size(F.array_intersect(own, known))
        return held | F.when(F.size(own) == 1, (shared == 1) & (F.char_length(F.get(own, F.lit(0))) >= 4)).otherwise(shared >= 2)

    return F.exists(aliases, matches)


def fits(candidates: DataFrame, requirements: DataFrame) -> DataFrame:
    """candidates with fits, map<requirement_id, share>: the named documents that each candidate is a passage of, and the share of their needs that it covers.

    candidates has query_id, id, text, names array<string>; requirements query_id, requirement_id, title, needs. Only
    passages that qualify and cover 0.34 of the needs count.
    """
    pairs = candidates.select("query_id", "id", "text", "names").join(requirements.select("query_id", "requirement_id", "title", "needs"), "query_id")
    good = pairs.where(is_document(F.col("title"), F.col("names")) & F.coalesce(qualifies(F.col("text")), F.lit(False))).withColumn("share", need_coverage(F.col("needs"), F.col("text"))).where(F.col("share") >= COVERED)
    of = good.groupBy("query_id", "id").agg(F.map_from_entries(F.collect_set(F.struct("requirement_id", "share"))).alias("fits"))
    return candidates.join(of, ["query_id", "id"], "left")
