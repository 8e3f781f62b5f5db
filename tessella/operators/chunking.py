"""Chunks of laid-out documents, and extractive summaries of parents: expressions, folds over a document's blocks and
groups that the fold's numbers make. No Python runs per row; documents are grouped once and stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import _trimmed, child_chunks, let, squeeze, text_units, truncated, word_tokens

# What marks a unit's category, names, values; the bounds of a summary.
CATEGORIES = {
    "Definition": r"(?iU)\b(?:we define|is defined as|refers to|denotes|is an?|are (?:an?|the)|means)\b",
    "Method": r"(?iU)\b(?:we (?:use|used|propose|introduce|develop)|method|approach|pipeline|protocol|dataset|experiment)\b",
    "Result": r"(?iU)\b(?:we (?:find|found|show|demonstrate|observe|report)|results? show|achiev(?:e|ed)|outperform(?:s|ed)?|improv(?:e|ed|ement)|increase(?:d)?|decrease(?:d)?|significant(?:ly)?)\b",
    "Limitation": r"(?iU)\b(?:limitation|caveat|however|although|despite|restricted to|may not|cannot|future work)\b",
    "Conclusion": r"(?iU)\b(?:we conclude|in conclusion|overall|therefore|thus|these findings|our findings)\b",
}
ORDER = ("Result", "Definition", "Method", "Limitation", "Conclusion")
VALUE = r"(?U)(?<![\w.])[-+]?\d+(?:[.,]\d+)*\s*(?:%|[A-Za-zµμ°€]{1,8}\b)?"
NAME = r"(?U)\b(?:[A-Z][\w-]*[A-Z0-9][\w-]*|[A-Z][a-zÀ-ɏ]+(?:\s+[A-Z][a-zÀ-ɏ]+)*)\b"
SUMMARY, META, UNIT_LEAST, UNIT_MOST, UNITS = 700, 110, 56, 180, 5
NAMES, VALUES = 6, 8
HEADS, EDGES, CLOSING = ("title", "heading"), ("header", "footer"), ("caption", "footnote")


def _found(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), squeeze)


def names(text: Column) -> Column:
    """The six names that a text has most often; of equals the first, then in the order of the alphabet."""

    def ranked(found: Column) -> Column:
        first = lambda x: F.position(F.split_part(x, F.lit(" "), F.lit(1)), text)
        keys = F.transform(F.array_distinct(found), lambda x: F.struct((-F.size(F.filter(found, lambda y: y == x))).alias("n"), first(x).alias("at"), F.lower(x).alias("l"), x.alias("name")))
        return F.transform(F.slice(F.array_sort(keys), 1, NAMES), lambda k: k["name"])

    return let(F.filter(_found(text, NAME), lambda x: F.char_length(x) > 1), ranked)


def values(text: Column) -> Column:
    """The first eight values with their units, each once whatever its letter case."""
    return let(_found(text, VALUE), lambda v: let(F.transform(v, F.lower), lambda low: F.slice(F.filter(v, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, VALUES)))


def weighed(parts: Column) -> Column:
    """array<struct<i, w, kinds, valued>>: each unit with its weight and the categories that it shows signs of."""

    def one(u: Column, i: Column) -> Column:
        kinds = F.array(*[u.rlike(p) for p in CATEGORIES.values()])
        n_names, n_values = F.regexp_count(u, F.lit(NAME)), F.regexp_count(u, F.lit(VALUE))
        place = F.when(i == 0, 0.5).otherwise(0.0) + F.when(i == F.size(parts) - 1, 0.35).otherwise(0.0)
        length = F.least(F.regexp_count(u, F.lit(r"\S+")), F.lit(60)) / 60
        return let(kinds, lambda k: F.struct(i.alias("i"), (0.6 * n_names + 0.8 * n_values + F.size(F.filter(k, lambda x: x)) + length + place).alias("w"), k.alias("kinds"), (n_values > 0).alias("valued")))

    return F.transform(parts, one)


def _chosen(units: Column) -> Column:
    """array<struct<label, i>>: for each category in turn the weightiest unit of it that none before has taken, in the order of a summary."""
    labels = list(CATEGORIES)
    nothing = F.array().cast("array<struct<label:int,i:int>>")
    late = F.lit(len(labels))

    def take(taken: Column, label: Column) -> Column:
        free = F.filter(units, lambda u: F.get(u["kinds"], label) & ~F.exists(taken, lambda t: t["i"] == u["i"]))
        bonus = lambda u: F.when((label == labels.index("Result")) & u["valued"], 2.0).when(label >= labels.index("Limitation"), u["i"] / F.greatest(F.size(units) - 1, F.lit(1))).otherwise(0.0)
        best = F.array_max(F.transform(free, lambda u: F.struct((u["w"] + bonus(u)).alias("w"), (-u["i"]).alias("i"))))
        return let(best, lambda b: F.when(b.isNull(), taken).otherwise(F.array_append(taken, F.struct(label.alias("label"), (-b["i"]).cast("int").alias("i")))))

    rank = F.create_map(*[F.lit(x) for n in labels for x in (labels.index(n), ORDER.index(n))])
    found = F.aggregate(F.sequence(F.lit(0), late - 1), nothing, take)
    return F.transform(F.array_sort(F.transform(found, lambda c: F.struct(F.try_element_at(rank, c["label"]).alias("rank"), c["label"].alias("label"), c["i"].alias("i")))), lambda c: F.struct(c["label"].alias("label"), c["i"].alias("i")))


def summary(text: Column, headings: Column | None = None) -> Column:
    """At most 700 characters of a parent's own words: its section, names and values, then the units that say most.

    Each category of units gets the best one that is free; what room is left goes to the weightiest others. Null gives
    null, a text of one unit that unit.
    """
    none = F.lit(None).cast("string")
    section = F.nullif(F.array_join(F.filter(F.transform(headings, squeeze), lambda x: x != ""), " > "), F.lit("")) if headings is not None else none
    label_names = F.array(*[F.lit(x) for x in (*CATEGORIES, "Context")])
    context = len(CATEGORIES)

    def said(parts: Column) -> Column:
        listed = lambda title, array, glue: F.when(F.size(array) > 0, F.concat(F.lit(f"{title}: "), truncated(F.array_join(array, glue), META)))
        head = F.array_compact(F.array(F.when(section.isNotNull(), F.concat(F.lit("Section: "), truncated(section, META))), let(names(text), lambda x: listed("Entities", x, "; ")), let(values(text), lambda x: listed("Values", x, "; "))))
        return let(weighed(parts), lambda units: let(_picked(units), lambda picked: let(head, lambda h: joined(parts, picked, h))))

    def _picked(units: Column) -> Column:
        first = F.array(F.struct(F.lit(context).alias("label"), F.lit(0).alias("i")))

        def filled(chosen: Column) -> Column:
            others = F.filter(units, lambda u: ~F.exists(chosen, lambda c: c["i"] == u["i"]))
            weighty = F.reverse(F.array_sort(F.transform(others, lambda u: F.struct(u["w"].alias("w"), u["i"].alias("i")))))
            more = F.slice(weighty, F.lit(1), F.greatest(F.lit(UNITS) - F.size(chosen), F.lit(0)))
            return F.concat(chosen, F.transform(more, lambda m: F.struct(F.lit(context).alias("label"), m["i"].cast("int").alias("i"))))

        return let(_chosen(units), lambda c: let(F.when(F.size(c) > 0, c).otherwise(first), filled))

    def joined(parts: Column, picked: Column, head: Column) -> Column:
        n = F.size(picked)
        labels = F.aggregate(picked, F.lit(0), lambda a, p: a + F.char_length(F.get(label_names, p["label"])) + 2)
        room = F.lit(SUMMARY) - F.char_length(F.array_join(head, " ")) - labels - F.size(head) - n
        each = F.least(F.lit(UNIT_MOST), F.greatest(F.lit(UNIT_LEAST), F.floor(F.greatest(n * UNIT_LEAST, room) / n).cast("int")))
        return let(each, lambda e: truncated(F.array_join(F.concat(head, F.transform(picked, lambda p: F.concat(F.get(label_names, p["label"]), F.lit(": "), truncated(F.get(parts, p["i"]), e)))), " "), SUMMARY))

    parts = F.transform(text_units(text), squeeze)
    return let(parts, lambda p: F.when(text.isNull(), none).when(F.size(p) == 0, truncated(text, SUMMARY)).when((F.size(p) == 1) & section.isNull(), truncated(F.get(p, F.lit(0)), SUMMARY)).otherwise(said(p)))


def _numbered(blocks: Column, parent_target: int, parent_most: int, child_target: int, child_most: int) -> Column:
    """array<struct<p, c>> beside the blocks of a document: the parent of each, and its child (-1 for headings).

    One fold in the order of blocks. What it carries is sizes and keys, not texts; the numbers of a parent's blocks
    are appended to a list of their own, so that a long document doesn't copy one long list at each step.
    """
    entry = "array<struct<p:int,c:int>>"
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit("").alias("path"), F.lit(False).alias("any"), F.lit(-1).alias("c"), F.lit(0).alias("m"), F.lit("").alias("key"), F.lit(False).alias("open"), F.array().cast(entry).alias("now"), F.array().cast(f"array<{entry}>").alias("done"))

    def step(a: Column, b: Column) -> Column:
        own, size = b["path"], b["size"]
        changed = (own != "") & (a["path"] != "") & (own != a["path"]) & (a["n"] >= max(64, parent_target // 3))
        closes = a["any"] & ((a["n"] + size > parent_most) | changed)
        return let(F.struct(closes.alias("closes"), F.when(closes, size).otherwise(a["n"] + size).alias("n")), lambda s: placed(a, b, s))

    def placed(a: Column, b: Column, s: Column) -> Column:
        size, head = b["size"], b["kind"].isin(*HEADS)
        full = (s["n"] >= min(parent_target, parent_most)) & ~head
        p = a["p"] + s["closes"].cast("int")
        path = F.when(b["path"] != "", b["path"]).when(s["closes"], F.lit("")).otherwise(a["path"])
        # a child stays open for blocks of its section, page and kind, until it is large enough
        goes_on = a["open"] & ~s["closes"] & ~b["alone"] & (a["key"] == b["key"]) & (a["m"] + size <= child_most)
        m = F.when(goes_on, a["m"]).otherwise(0) + size
        c = F.when(head, a["c"]).when(goes_on, a["c"]).otherwise(a["c"] + 1)
        open_ = F.when(head, a["open"] & ~s["closes"]).otherwise(~b["alone"] & (m < min(child_target, child_most)) & ~b["kind"].isin(*CLOSING))
        here = F.struct(p.cast("int").alias("p"), F.when(head, F.lit(-1)).otherwise(c).cast("int").alias("c"))
        now = F.array_append(F.when(s["closes"], F.array().cast(entry)).otherwise(a["now"]), here)
        done = F.when(s["closes"], F.array_append(a["done"], a["now"])).otherwise(a["done"])
        return F.struct(
            (p + full.cast("int")).cast("int").alias("p"),
            F.when(full, 0).otherwise(s["n"]).cast("int").alias("n"),
            F.when(full, F.lit("")).otherwise(path).alias("path"),
            (~full).alias("any"),
            c.cast("int").alias("c"),
            F.when(head, a["m"]).otherwise(m).cast("int").alias("m"),
            F.when(head, a["key"]).otherwise(b["key"]).alias("key"),
            (open_ & ~full).alias("open"),
            F.when(full, F.array().cast(entry)).otherwise(now).alias("now"),
            F.when(full, F.array_append(done, now)).otherwise(done).alias("done"),
        )

    return F.aggregate(blocks, start, step, lambda a: F.flatten(F.array_append(a["done"], a["now"])))


def table_parts(text: Column, most: int) -> Column:
    """A table's text in parts of at most most words, each under its first line; whole if it fits or has no second line."""

    def split(lines: Column) -> Column:
        head = F.get(lines, F.lit(0))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), word_tokens(head).alias("n"))

        def step(a: Column, line: Column) -> Column:
            n = word_tokens(line)
            full = (a["text"] != "") & (a["n"] + n > most)
            added = F.when(full | (a["text"] == ""), line).otherwise(F.concat_ws("\n", a["text"], line))
            return F.struct(F.when(full, F.array_append(a["done"], a["text"])).otherwise(a["done"]).alias("done"), added.alias("text"), (F.when(full, word_tokens(head)).otherwise(a["n"]) + n).cast("int").alias("n"))

        rows = F.aggregate(F.slice(lines, 2, F.size(lines) - 1), start, step, lambda a: F.array_append(a["done"], a["text"]))
        return F.transform(rows, lambda r: F.concat_ws("\n", head, r))

    return let(_trimmed(F.split(text, "\n")), lambda lines: F.when((word_tokens(text) <= most) | (F.size(lines) < 2), F.array(text)).otherwise(split(lines)))


def structured_chunks(blocks: DataFrame, parent_target: int = 520, parent_most: int = 650, child_target: int = 110, child_most: int = 150) -> DataFrame:
    """doc_id, parent_no, child_no, text, block_type, heading_path, page, page_end, first_block, bounding_box, table_part of laid-out documents.

    blocks has doc_id, block_index, block_type, text, heading_path array<string>, page_number, bounding_box. Heads and
    feet of pages are left out. A parent closes before it would exceed parent_most words, where the section changes
    once it has a third of parent_target (64 at least), and at parent_target, unless a heading ends it. Its children
    keep to one section, page and type; tables stand alone, and a long one is split with its header repeated; a
    caption or footnote closes a child. A document without text gives no rows; repeated blocks count once.
    """
    said = F.regexp_replace("text", r"^\s+|\s+$", "")
    path = F.coalesce(F.array_join("heading_path", "\x01"), F.lit(""))
    kind = F.coalesce("block_type", F.lit(""))
    rows = blocks.where(F.col("doc_id").isNotNull() & (said != "") & ~kind.isin(*EDGES)).dropDuplicates(["doc_id", "block_index"])
    size = word_tokens(F.col("text"))
    key = F.concat_ws("\x02", path, F.coalesce(F.col("page_number").cast("string"), F.lit("")), kind)
    one = F.struct(F.col("block_index").alias("i"), said.alias("text"), kind.alias("kind"), path.alias("path"), key.alias("key"), size.alias("size"), ((kind == "table") | (size > child_most)).alias("alone"), "heading_path", F.col("page_number").alias("page"), F.col("bounding_box").alias("box"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one), lambda x, y: F.when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0)).alias("b"))
    docs = docs.withColumn("at", _numbered(F.col("b"), parent_target, parent_most, child_target, child_most))
    flat = docs.select("doc_id", F.explode(F.arrays_zip("b", "at")).alias("x")).select("doc_id", "x.at.p", "x.at.c", "x.b.*").where("c >= 0")
    box = F.when(F.size("box") == 4, F.col("box"))
    children = flat.groupBy("doc_id", "p", "c").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.min(F.struct("i", "kind", "heading_path", "page", "alone")).alias("first"),
        F.array(*[(F.min if k < 2 else F.max)(F.get(box, F.lit(k))) for k in range(4)]).alias("_box"),
    )
    table = F.col("first.kind") == "table"
    pieces = F.when(table, table_parts(F.col("text"), child_most)).when(F.col("first.alone"), F.transform(child_chunks(F.col("text"), child_target, child_most), squeeze)).otherwise(F.array("text"))
    children = children.withColumn("pieces", pieces)
    children = children.select("*", F.posexplode("pieces").alias("k", "piece"))
    order = Window.partitionBy("doc_id").orderBy("c", "k")
    part = F.when(table & (F.size("pieces") > 1), F.concat_ws("/", (F.col("k") + 1).cast("string"), F.size("pieces").cast("string")))
    return children.select(
        "doc_id",
        F.col("p").alias("parent_no"),
        (F.row_number().over(order) - 1).alias("child_no"),
        F.col("piece").alias("text"),
        F.col("first.kind").alias("block_type"),
        F.coalesce("first.heading_path", F.array().cast("array<string>")).alias("heading_path"),
        F.col("first.page").alias("page"),
        F.col("first.page").alias("page_end"),
        F.col("first.i").alias("first_block"),
        F.when(F.col("first.page").isNotNull() & F.get("_box", F.lit(0)).isNotNull(), F.col("_box")).alias("bounding_box"),
        part.alias("table_part"),
    )
