"""Evidence: requirements and their ledger, claims checked against what they cite, citation accounting.

Claims, numbers and terms are arrays of one row per answer or claim, so checks are expressions inside one stage; only
the join of claims with their sources shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import cited_ids, jaccard, strip_hidden, subqueries, term_root, term_set
from tessella.operators.named import targets
from tessella.session import materialise

# Stopwords of claims, spellings of units, thresholds.
CLAIM_STOPWORDS = (
    "about", "after", "again", "also", "because", "before", "being", "between", "could", "does", "from", "have", "into", "more",
    "most", "other", "should", "than", "that", "their", "there", "these", "they", "this", "those", "through", "using", "very",
    "were", "what", "when", "where", "which", "while", "with", "would", "your", "did", "not", "never", "without", "failed",
)
UNIT_NAMES = {"percent": "%", "percentage": "%", "millisecond": "ms", "milliseconds": "ms", "msec": "ms", "second": "s", "seconds": "s", "sec": "s", "minute": "min", "minutes": "min", "joule": "j", "joules": "j", "watt": "w", "watts": "w", "gram": "g", "grams": "g", "kilogram": "kg", "kilograms": "kg"}
ENTAILED, PARTIAL, LIKE, NEAR, NEAREST = 0.55, 0.25, 0.45, 0.01, 1e-6
MOST_CLAIMS, MOST_NUMBERS = 32, 32
SUFFICIENT, PER_REQUIREMENT = 0.34, 4
TAG = r"\[\[\s*src\s*:\s*[A-Za-z0-9_-]+\s*\]\]"
TAG_LIKE = r"(?i)\[\[?\s*src\s*:[^\]]*\]?\]"
NEGATION = r"(?i)\b(?:no|not|never|neither|without|failed to|did not|does not|was not|were not)\b"
NUMBER = r"(?<![\w.-])(-?\d+(?:\.\d+)?)\s*(%|[a-zA-Zµμ°]+)?"


def claim_terms(text: Column) -> Column:
    words = term_set(text, CLAIM_STOPWORDS, 3, r"[\p{L}\p{N}_.-]+")
    return F.array_distinct(F.transform(words, term_root))


def split_claims(answer: Column) -> Column:
    """array<struct<claim_id, text, source_ids>>: an answer's first 32 statements of two terms or more.

    A tag that follows a full stop belongs to the sentence before it; tags are not part of a claim's text."""
    visible = strip_hidden(answer)
    joined = F.regexp_replace(visible, rf"(?i)([.!?])\s+((?:{TAG}\s*)+)", "$1 $2\n")
    parts = F.slice(F.filter(F.split(joined, r"(?i)(?<=[.!?])\s+(?!\[\[\s*src\s*:)|\n+"), lambda x: F.trim(x) != ""), 1, MOST_CLAIMS)
    made = F.transform(parts, lambda x, i: F.struct(F.concat(F.lit("C"), (i + 1).cast("string")).alias("claim_id"), F.regexp_replace(F.regexp_replace(x, f"(?i){TAG}", ""), r"^[ \-*#\t]+|[ \-*#\t]+$", "").alias("text"), cited_ids(x).alias("source_ids")))
    return F.filter(made, lambda c: F.size(claim_terms(c["text"])) >= 2)


def unit_name(unit: Column) -> Column:
    """A unit of one letter as it is written; others in lower case and by one name."""
    raw = F.replace(F.coalesce(unit, F.lit("")), F.lit("μ"), F.lit("µ"))
    known = F.create_map(*[F.lit(x) for kv in UNIT_NAMES.items() for x in kv])
    return F.when(raw.rlike(r"^\p{L}$"), raw).otherwise(F.coalesce(F.try_element_at(known, F.lower(raw)), F.lower(raw)))


def numbers_in(text: Column, most: int | None = MOST_NUMBERS) -> Column:
    """array<struct<value, unit>> of the first 32 numbers, or of all."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    found = found if most is None else F.slice(found, 1, most)
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^(-?\d+(?:\.\d+)?)", 1).cast("double").alias("value"), unit_name(F.regexp_extract(m, r"^-?\d+(?:\.\d+)?\s*(.*)$", 1)).alias("unit")))


def close(stated: Column, computed: Column) -> Column:
    """Within a hundredth of the stated value."""
    return F.abs(stated - computed) <= F.greatest(F.lit(NEAREST), F.abs(stated) * NEAR)


def numeric_status(claim: Column, evidence: Column, stated: Column, has: Column) -> Column:
    """not_applicable, entailed, contradicted or unsupported; stated and has are the numbers of claim and evidence.

    Each of the claim's numbers must stand in the evidence, in its unit, or follow from it: a percentage as the
    relative change of the first two values of one unit, and by the claim's own words as difference, mean or sum. One
    that has comparable values but matches none contradicts; one without any is unsupported."""
    lower = F.lower(claim)

    def check(c: Column) -> Column:
        same = F.filter(has, lambda e: e["unit"] == c["unit"])
        values = F.transform(same, lambda e: e["value"])
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        others = F.filter(has, lambda e: (e["unit"] != "%") & (e["unit"] != ""))
        paired = F.filter(others, lambda e: F.size(F.filter(others, lambda o: o["unit"] == e["unit"])) >= 2)
        first = F.try_element_at(paired, F.lit(1))
        two = F.transform(F.filter(paired, lambda o: o["unit"] == first["unit"]), lambda e: e["value"])
        l, r = F.try_element_at(two, F.lit(1)), F.try_element_at(two, F.lit(2))
        change = F.when(F.abs(l) > NEAREST, F.abs(l - r) / F.abs(l)).when(F.abs(r) > NEAREST, F.abs(l - r) / F.abs(r)) * 100
        derived = (
            F.when((c["unit"] == "%") & change.isNotNull(), change)
            .when((F.size(values) >= 2) & lower.rlike(r"\b(?:difference|differed|gap)\b"), F.abs(F.try_element_at(values, F.lit(1)) - F.try_element_at(values, F.lit(2))))
            .when((F.size(values) >= 1) & lower.rlike(r"\b(?:average|mean)\b"), total / F.size(values))
            .when((F.size(values) >= 1) & lower.rlike(r"\b(?:sum|total)\b"), total)
        )
        return F.when(F.exists(values, lambda v: close(c["value"], v)), "entailed").when(derived.isNotNull(), F.when(close(c["value"], derived), "entailed").otherwise("contradicted")).when(F.size(values) > 0, "contradicted").otherwise("unsupported")

    conflict = direction_conflict(claim, evidence, has)
    # one fold instead of an array that each test would build again: the worst of the checks, and whether there is any
    worst = F.aggregate(stated, F.lit(0), lambda a, c: F.greatest(a, F.when(check(c) == "contradicted", 3).when(check(c) == "unsupported", 2).otherwise(1)))
    return F.when(F.size(stated) == 0, "not_applicable").when((worst == 3) | conflict, "contradicted").when(worst == 2, "unsupported").otherwise("entailed")


def direction_conflict(claim: Column, evidence: Column, has: Column) -> Column:
    """Whether a claim says rise where evidence that goes from one value to another falls, or the reverse."""
    lower = F.lower(claim)
    named = F.filter(has, lambda e: e["unit"] != "")
    paired = F.filter(named, lambda e: F.size(F.filter(named, lambda o: o["unit"] == e["unit"])) >= 2)
    unit = F.try_element_at(paired, F.lit(1))["unit"]
    two = F.transform(F.filter(paired, lambda o: o["unit"] == unit), lambda e: e["value"])
    delta = F.try_element_at(two, F.lit(2)) - F.try_element_at(two, F.lit(1))
    falls = lower.rlike(r"\b(?:decreas\w*|reduc\w*|lower\w*|faster)\b") | (lower.contains("improv") & lower.rlike(r"\b(?:latency|time|error|loss)\b"))
    rises = lower.rlike(r"\b(?:increas\w*|higher\w*|grew|slower)\b")
    stated = F.lower(evidence).contains("from") & F.lower(evidence).contains(" to ")
    return F.coalesce(stated & ((falls & (delta > 0)) | (rises & (delta < 0))), F.lit(False))


def negation_conflict(claim: Column, evidence: Column) -> Column:
    """Alike in terms, opposite in polarity."""
    return (jaccard(claim_terms(claim), claim_terms(evidence)) >= LIKE) & (claim.rlike(NEGATION) != evidence.rlike(NEGATION))


def verify_claims(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, claim_id, text, source_ids, coverage, numeric_status, status of each claim of each answer.

    answers has answer_id, text; sources answer_id, source_id, text. In this order: no citation; an unknown one;
    numbers that contradict; opposite negation; numbers without support; the best source's share of the claim's terms.
    """
    claims = answers.select("answer_id", F.posexplode(split_claims(F.col("text"))).alias("_n", "c")).select("answer_id", "_n", "c.*")
    cited = claims.select("answer_id", "_n", F.col("text").alias("_text"), F.posexplode("source_ids").alias("_at", "_id"))
    known = sources.select("answer_id", F.upper("source_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_e")).dropDuplicates(["answer_id", "_id"])
    met = cited.join(known, ["answer_id", "_id"], "left")
    terms = claim_terms(F.col("_text"))
    shared = F.when(F.col("_e").isNotNull(), F.size(F.array_intersect(terms, claim_terms(F.col("_e")))) / F.size(terms))
    of = met.groupBy("answer_id", "_n").agg(
        F.max(F.coalesce(shared, F.lit(0.0))).alias("_cover"),
        F.max(F.col("_e").isNull()).alias("_unknown"),
        F.max(F.coalesce(negation_conflict(F.col("_text"), F.col("_e")), F.lit(False))).alias("_negated"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_e"))), lambda x: x["_e"]), "\n").alias("_evidence"),
    )
    out = claims.join(of, ["answer_id", "_n"], "left")
    out = out.withColumn("_e", F.coalesce("_evidence", F.lit(""))).withColumn("_said", numbers_in(F.col("text"))).withColumn("_has", numbers_in(F.col("_e")))
    numeric = numeric_status(F.col("text"), F.col("_e"), F.col("_said"), F.col("_has"))
    cover = F.round(F.coalesce("_cover", F.lit(0.0)), 6)
    status = (
        F.when(F.size("source_ids") == 0, "citation_missing")
        .when(F.col("_unknown"), "unsupported")
        .when(F.col("numeric_status") == "contradicted", "contradicted")
        .when(F.col("_negated"), "contradicted")
        .when(F.col("numeric_status") == "unsupported", "unsupported")
        .when(cover >= ENTAILED, "entailed")
        .when(cover >= PARTIAL, "partially_entailed")
        .otherwise("unsupported")
    )
    return out.withColumn("numeric_status", numeric).select("answer_id", "claim_id", "text", "source_ids", cover.alias("coverage"), "numeric_status", status.alias("status"))


def claim_summary(claims: DataFrame) -> DataFrame:
    """Counts of each status per answer."""
    return claims.groupBy("answer_id").agg(F.count("*").alias("claim_count"), *[F.count_if(F.col("status") == s).alias(s) for s in ("entailed", "partially_entailed", "unsupported", "contradicted", "citation_missing")])


def cell_check(operation: Column, stated: Column, stated_unit: Column, values: Column, unit: Column) -> Column:
    """Whether a stated number is what an operation makes of cited cells: entailed, contradicted, unit_mismatch, missing_cell."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    computed = (
        F.when(operation == "count", n.cast("double"))
        .when(operation == "sum", total)
        .when(operation == "mean", total / n)
        .when(operation == "min", F.array_min(values))
        .when(operation == "max", F.array_max(values))
        .when(operation == "difference", F.try_element_at(values, F.lit(1)) - F.try_element_at(values, F.lit(2)))
        .when(operation == "percentage", F.try_divide(F.try_element_at(values, F.lit(1)) - F.try_element_at(values, F.lit(2)), F.try_element_at(values, F.lit(2))) * 100)
        .when(F.exists(values, lambda v: close(stated, v)), stated)
        .otherwise(F.try_element_at(values, F.lit(1)))
    )
    return F.when((n == 0) & (operation != "count"), "missing_cell").when((F.coalesce(stated_unit, F.lit("")) != "") & (unit_name(stated_unit) != unit_name(unit)), "unit_mismatch").when(computed.isNull(), "ambiguous_operation").when(close(stated, computed), "entailed").otherwise("contradicted")


def citation_accounting(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """A row per answer: citations made, valid, unknown, repeated, malformed, sources left uncited, precision."""
    visible = strip_hidden(F.col("text"))
    tags = F.transform(F.regexp_extract_all(visible, F.lit(r"(?i)\[\[\s*src\s*:\s*([A-Za-z0-9_-]+)\s*\]\]"), F.lit(1)), F.upper)
    like = F.size(F.regexp_extract_all(visible, F.lit(TAG_LIKE), F.lit(0)))
    there = sources.groupBy("answer_id").agg(F.array_sort(F.collect_set(F.upper("source_id"))).alias("_there"))
    of = answers.select("answer_id", tags.alias("_tags"), like.alias("_like")).join(there, "answer_id", "left")
    none = F.array().cast("array<string>")
    have = F.coalesce("_there", none)
    ids = F.array_distinct("_tags")
    valid, unknown = F.filter(ids, lambda x: F.array_contains(have, x)), F.filter(ids, lambda x: ~F.array_contains(have, x))
    repeated = F.array_sort(F.filter(ids, lambda x: F.size(F.filter(F.col("_tags"), lambda t: t == x)) > 1))
    precision = F.when(F.size(ids) == 0, F.lit(0.0)).otherwise(F.round(F.size(valid) / F.size(ids), 6))
    return of.select("answer_id", F.size("_tags").alias("citation_count"), F.size(ids).alias("unique_count"), F.size(valid).alias("valid_count"), F.size(unknown).alias("invalid_count"), F.array_join(repeated, ",").alias("repeated_ids"), (F.col("_like") - F.size("_tags")).alias("malformed_count"), F.size(F.array_except(have, ids)).alias("uncited_count"), precision.alias("precision"))


def citation_support(rerank: Column, score: Column) -> Column:
    """supported, weak or unsupported by the score of what is cited; null scores support nothing."""
    r = F.coalesce(rerank, score)
    return F.when((r >= 0.45) | (score >= 0.55), "supported").when(r >= 0.1, "weak").otherwise("unsupported")


def requirements(queries: DataFrame) -> DataFrame:
    """query_id, requirement_id, text, named: a requirement for each named title (eight at most), else each subquery but the whole."""
    titles = targets(F.col("text"))
    named = F.transform(F.slice(titles, 1, 8), lambda t, i: F.struct(F.concat(F.lit("r"), (i + 1).cast("string")).alias("requirement_id"), t.alias("text"), F.lit(True).alias("named")))
    parts = F.transform(F.filter(subqueries(F.col("text")), lambda s: s["id"] != "q0"), lambda s: F.struct(s["id"].alias("requirement_id"), s["text"].alias("text"), F.lit(False).alias("named")))
    return queries.select("query_id", F.explode(F.when(F.size(titles) > 0, named).otherwise(parts)).alias("r")).select("query_id", "r.*")


def ledger(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, requirement_id, n_evidence, best, status: what each requirement finds among a query's sources.

    A source's score is its share of the requirement's terms; four sources at most are counted for one. 0.34 is
    sufficient, anything above 0 partial, nothing missing. evidence has query_id, source_id, text; where it has doc_id
    too, a requirement of which two sources are in conflict is conflicting, whatever else it has.
    """
    need = requirements.select("query_id", "requirement_id", term_set(F.col("text")).alias("_need"))
    have = evidence.select("query_id", "source_id", term_set(F.col("text")).alias("_have"))
    pairs = need.join(have, "query_id").withColumn("_s", F.when(F.size("_need") > 0, F.size(F.array_intersect("_need", "_have")) / F.size("_need")).otherwise(0.0))
    at = Window.partitionBy("query_id", "requirement_id").orderBy(F.desc("_s"), "source_id")
    kept = pairs.where("_s > 0").withColumn("_k", F.row_number().over(at)).where(F.col("_k") <= PER_REQUIREMENT)
    of = kept.groupBy("query_id", "requirement_id").agg(F.count("*").alias("n_evidence"), F.round(F.max("_s"), 6).alias("best"))
    out = need.select("query_id", "requirement_id").join(of, ["query_id", "requirement_id"], "left")
    out = out.withColumn("_conflict", F.lit(False))
    if "doc_id" in evidence.columns:
        met = pairs.where("_s > 0").select("query_id", "requirement_id", "source_id").distinct()
        against = conflicts(evidence).select("query_id", F.col("left_id").alias("source_id"), "right_id").join(met, ["query_id", "source_id"])
        against = against.select("query_id", "requirement_id", F.col("right_id").alias("source_id")).join(met, ["query_id", "requirement_id", "source_id"]).select("query_id", "requirement_id", F.lit(True).alias("_c")).distinct()
        out = out.join(against, ["query_id", "requirement_id"], "left").withColumn("_conflict", F.coalesce("_c", F.lit(False)))
    best = F.coalesce("best", F.lit(0.0))
    return out.select("query_id", "requirement_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), best.alias("best"), F.when(F.col("_conflict"), "conflicting").when(best >= SUFFICIENT, "sufficient").when(best > 0, "partial").otherwise("missing").alias("status"))


def values_conflict(left: Column, right: Column) -> Column:
    """Whether either has a number in a unit that the other states only other values in, by more than a thousandth."""

    def lacks(x: Column, y: Column) -> Column:
        return F.exists(x, lambda v: F.exists(y, lambda w: w["unit"] == v["unit"]) & ~F.exists(y, lambda w: (w["unit"] == v["unit"]) & (F.abs(v["value"] - w["value"]) <= F.greatest(F.lit(1e-9), F.abs(v["value"]) * 0.001))))

    return lacks(left, right) | lacks(right, left)


def conflicts(evidence: DataFrame) -> DataFrame:
    """query_id, left_id, right_id, reason: alike sources of different documents, one of which negates or that state different values in one unit.

    Sources meet within a query and a term they share, of so many of their rarest ones that alike sources share one:
    evidence has query_id, source_id, doc_id, text, with any number of sources a query. Repeated rows count once.
    """
    rows = evidence.select("query_id", "source_id", F.col("doc_id").alias("doc"), claim_terms(F.col("text")).alias("t"), F.col("text").rlike(NEGATION).alias("n"), F.array_distinct(F.filter(numbers_in(F.col("text"), None), lambda x: x["unit"] != "")).alias("v"))
    rows = materialise(rows.where("query_id is not null and source_id is not null and doc is not null and size(t) > 0").distinct(), "conflict-terms")
    each = rows.select("query_id", "source_id", F.size("t").alias("size"), F.explode("t").alias("term"))
    ranked = each.join(each.groupBy("query_id", "term").agg(F.count("*").alias("often")), ["query_id", "term"])
    ranked = ranked.where("often > 1").groupBy("query_id", "source_id", "size").agg(F.array_sort(F.collect_set(F.struct("often", "term"))).alias("o"))
    # of size terms ceil(LIKE * size) at least are shared: leaving out one less, and those that no other has count as left out too
    least = F.ceil(F.col("size") * LIKE - NEAREST).cast("int")
    keys = ranked.where(F.size("o") >= least).select("query_id", "source_id", F.explode(F.slice("o", 1, F.size("o") - least + 1)["term"]).alias("term"))
    meeting = keys.join(rows.select("query_id", "source_id", "doc", "n", (F.size("v") > 0).alias("v")), ["query_id", "source_id"])
    a, b = meeting.alias("a"), meeting.alias("b")
    met = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source_id") < F.col("b.source_id")) & (F.col("a.doc") != F.col("b.doc")) & ((F.col("a.n") != F.col("b.n")) | (F.col("a.v") & F.col("b.v"))))
    met = met.select(F.col("a.query_id").alias("query_id"), F.col("a.source_id").alias("left_id"), F.col("b.source_id").alias("right_id")).distinct()
    left, right = (rows.select("query_id", F.col("source_id").alias(f"{x}_id"), *[F.col(c).alias(f"{x}_{c}") for c in ("doc", "t", "n", "v")]) for x in ("left", "right"))
    pairs = met.join(left, ["query_id", "left_id"]).join(right, ["query_id", "right_id"]).where("left_doc <> right_doc").where(jaccard(F.col("left_t"), F.col("right_t")) >= LIKE)
    reason = F.when(F.col("left_n") != F.col("right_n"), "negation").when(values_conflict(F.col("left_v"), F.col("right_v")), "values")
    return pairs.withColumn("reason", reason).where("reason is not null").select("query_id", "left_id", "right_id", "reason").distinct()


def direction_check(claim: Column, results: Column) -> Column:
    """entailed, contradicted or ambiguous_operation: whether a claim's first direction word is what comparing the cited cells gave; not_applicable without results."""
    said = F.regexp_extract(F.lower(claim), r"\b(greater)\b", 1)
    for word in ("less", "equal"):
        said = F.when(said != "", said).otherwise(F.regexp_extract(F.lower(claim), rf"\b({word})\b", 1))
    return F.when(F.coalesce(F.size(results), F.lit(0)) <= 0, "not_applicable").when(said == "", "ambiguous_operation").when(F.array_contains(F.transform(results, F.lower), said), "entailed").otherwise("contradicted")


def ledger_counts(entries: DataFrame) -> DataFrame:
    """Counts of each status per query."""
    return entries.groupBy("query_id").agg(F.count("*").alias("requirements"), *[F.count_if(F.col("status") == s).alias(s) for s in ("sufficient", "partial", "missing", "conflicting")])


def sources_from_context(context: Column) -> Column:
    """array<struct<source_id, text>>: what stands behind each tag of a prompt's context, up to the next one."""
    parts = F.slice(F.split(context, r"(?i)(?=\[\[\s*src\s*:)"), 1, 1000)
    tagged = F.filter(parts, lambda p: p.rlike(rf"(?i)^{TAG}"))
    return F.transform(tagged, lambda p: F.struct(F.upper(F.regexp_extract(p, r"(?i)^\[\[\s*src\s*:\s*([A-Za-z0-9_-]+)", 1)).alias("source_id"), F.trim(F.regexp_replace(p, rf"(?i)^{TAG}", "")).alias("text")))


def audit(claims: DataFrame, judged: DataFrame) -> DataFrame:
    """claims with a model's verdicts (answer_id, claim_id, verdict): a hard failure of the deterministic check stands, else the verdict does."""
    both = claims.join(judged, ["answer_id", "claim_id"], "left")
    return both.withColumn("final", F.when(F.col("status").isin("contradicted", "citation_missing"), F.col("status")).otherwise(F.coalesce("verdict", "status"))).drop("verdict")
