"""Pages of words to lines, tables and blocks. A page is a group: its words are few, so what needs them all at once
runs over one page in pandas; what needs a document runs as windows over its lines."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Tolerances in points, shares of a page's height.
ROW_TOLERANCE, CELL_GAP, ALIGNED, ROW_GAP = 3.0, 24.0, 16.0, 32.0
TOP, BOTTOM, NEAR = 0.12, 0.10, 72.0
LINE = "doc_id bigint, page bigint, line_no int, text string, x0 double, top double, x1 double, bottom double, size double, bold boolean, cells array<string>"


def page_lines(words: DataFrame) -> DataFrame:
    """Lines of every page, with the cells that wide gaps part them into.

    words has doc_id, page, text, x0, top, x1, bottom, size, fontname. Words whose tops differ by 3 points at most
    from a line's median top are one line; a gap above 24 points, or 2.4 times the size, begins a new cell.
    """

    def lines(page: pd.DataFrame) -> pd.DataFrame:
        rows: list[list[int]] = []
        page = page.sort_values(["top", "x0"], ignore_index=True)
        tops = page["top"].to_numpy()
        for i in range(len(page)):
            for row in reversed(rows[-4:]):
                if abs(float(np.median(tops[row])) - tops[i]) <= ROW_TOLERANCE:
                    row.append(i)
                    break
            else:
                rows.append([i])
        out = []
        for n, row in enumerate(rows):
            w = page.iloc[row].sort_values("x0", ignore_index=True)
            size = float(w["size"].median())
            cells, last = [], None
            for text, x0, x1 in zip(w["text"], w["x0"], w["x1"], strict=True):
                if last is None or x0 - last > max(CELL_GAP, 2.4 * size):
                    cells.append(text)
                else:
                    cells[-1] += " " + text
                last = x1
            text = re.sub(r"\s+([,.;:!?)\]])", r"\1", " ".join(w["text"]))
            bold = bool(w["fontname"].fillna("").str.contains("bold", case=False).mean() > 0.5)
            out.append((page["doc_id"][0], page["page"][0], n, re.sub(r"([(\[])\s+", r"\1", text), w["x0"].min(), w["top"].min(), w["x1"].max(), w["bottom"].max(), size, bold, cells))
        return pd.DataFrame(out, columns=["doc_id", "page", "line_no", "text", "x0", "top", "x1", "bottom", "size", "bold", "cells"])

    return words.groupBy("doc_id", "page").applyInPandas(lines, LINE)


def borderless_tables(lines: DataFrame) -> DataFrame:
    """doc_id, page, table_no, first_line, last_line, rows: runs of two lines or more of equally many cells (2 to 12), no further apart than 32 points."""
    at = Window.partitionBy("doc_id", "page").orderBy("line_no")
    n = F.size("cells")
    fit = n.between(2, 12)
    new = ~fit | (F.lag(n).over(at) != n) | (F.lag(fit).over(at) != fit) | (F.col("top") - F.lag("bottom").over(at) > ROW_GAP) | (F.abs(F.col("x0") - F.lag("x0").over(at)) > ALIGNED) | F.lag("line_no").over(at).isNull()
    marked = lines.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_fit", fit)
    runs = marked.withColumn("_run", F.sum("_new").over(at)).where("_fit")
    of = runs.groupBy("doc_id", "page", "_run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "cells"))), lambda x: x["cells"]).alias("rows"))
    of = of.where(F.size("rows") >= 2)
    return of.withColumn("table_no", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("_run")) - 1).cast("int")).drop("_run")


def outside_boxes(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """Items whose centre lies in no box of their page: an anti join on containment, within pages. items has doc_id, page, x0, top, x1, bottom."""
    i, b = items.alias("i"), boxes.alias("b")
    x, y = (F.col("i.x0") + F.col("i.x1")) / 2, (F.col("i.top") + F.col("i.bottom")) / 2
    return i.join(b, (F.col("i.doc_id") == F.col("b.doc_id")) & (F.col("i.page") == F.col("b.page")) & x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.top"), F.col("b.bottom")), "left_anti")


def marginal_lines(lines: DataFrame, heights: DataFrame) -> DataFrame:
    """lines with repeated: text that, digits masked, stands at the edge of at least two pages and half of all.

    heights has doc_id, page, height. Edges are the top 12 % and the bottom 10 %.
    """
    pages = heights.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", r"\d+", "#"), r"\s+", " ")))
    rows = lines.join(heights, ["doc_id", "page"]).withColumn("_key", key).withColumn("_edge", (F.col("bottom") <= TOP * F.col("height")) | (F.col("top") >= (1 - BOTTOM) * F.col("height")))
    often = rows.where("_edge").groupBy("doc_id", "_key").agg(F.count_distinct("page").alias("_n")).join(pages, "doc_id").where(F.col("_n") >= F.greatest(F.lit(2), F.floor((F.col("_pages") + 1) / 2)))
    return rows.join(often.select("doc_id", "_key", F.lit(True).alias("_often")), ["doc_id", "_key"], "left").withColumn("repeated", F.col("_edge") & F.coalesce("_often", F.lit(False))).drop("_key", "_edge", "_often", "height")


def reading_order(lines: DataFrame, widths: DataFrame) -> DataFrame:
    """lines with reading_no: two columns are read one after the other between lines that span both.

    widths has doc_id, page, width. A line spans if it crosses the middle and is wider than 0.55 of the page.
    """
    rows = lines.join(widths, ["doc_id", "page"])
    middle = F.col("width") / 2
    spans = (F.col("x0") < middle) & (F.col("x1") > middle) & (F.col("x1") - F.col("x0") > 0.55 * F.col("width"))
    side = F.when(spans, 0).when((F.col("x0") + F.col("x1")) / 2 < middle, 1).otherwise(2)
    at = Window.partitionBy("doc_id", "page").orderBy("top", "x0")
    rows = rows.withColumn("_side", side).withColumn("_spans", spans.cast("int"))
    # a segment ends before and behind each spanning line
    segment = F.sum(F.col("_spans")).over(at.rowsBetween(Window.unboundedPreceding, 0)) * 2 - F.col("_spans")
    rows = rows.withColumn("_segment", segment)
    order = Window.partitionBy("doc_id", "page").orderBy("_segment", "_side", "top", "x0")
    return rows.withColumn("reading_no", F.row_number().over(order)).drop("_side", "_spans", "_segment", "width")


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body_size: the commonest size of lines, weighed by their length; the smaller of equals."""
    of = lines.groupBy("doc_id", F.round("size", 1).alias("_s")).agg(F.sum(F.char_length("text")).alias("_n"))
    return of.groupBy("doc_id").agg(F.max(F.struct("_n", (-F.col("_s")).alias("_m"))).alias("_t")).select("doc_id", (-F.col("_t._m")).alias("body_size"))


def line_type(text: Column, size: Column, body: Column, bold: Column, page: Column, line_no: Column) -> Column:
    words = F.regexp_count(text, F.lit(r"\S+"))
    large = size / body
    return (
        F.when(text.rlike(r"(?i)^(?:figure|fig\.|table|chart)\s*\d+"), "caption")
        .when(text.rlike(r"^\s*(?:[-•*]|\d{1,2}[.)])\s+\S"), "list")
        .when((large < 0.85) & text.rlike(r"^\s*(?:\d{1,2}|[*†‡])\s+\S"), "footnote")
        .when((page == 1) & (line_no == 0) & (large >= 1.35) & (words <= 20), "title")
        .when((words <= 14) & ~text.rlike(r"[.,;:]$") & ((large >= 1.15) | (bold & text.rlike(r"^(?:\d+(?:\.\d+)*\s+)?\p{Lu}"))), "heading")
        .otherwise("paragraph")
    )


def heading_level(size: Column, body: Column, text: Column) -> Column:
    """1 to 4: by the depth of its number, else by how much larger than the body it is."""
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    depth = F.least(F.size(F.split(number, r"\.")), F.lit(4))
    return F.when(number != "", depth).when(size / body >= 1.6, 1).when(size / body >= 1.3, 2).otherwise(3)


def blocks(lines: DataFrame) -> DataFrame:
    """Blocks of lines in reading order: a gap, another type or size, or a caption, heading or list item begins a new one.

    lines has doc_id, page, reading_no, text, type, size, x0, top, x1, bottom, level. Words cut at line ends are joined.
    """
    at = Window.partitionBy("doc_id", "page").orderBy("reading_no")
    gap = F.col("top") - F.lag("bottom").over(at)
    new = F.lag("type").over(at).isNull() | (F.lag("type").over(at) != F.col("type")) | F.col("type").isin("heading", "title", "list", "caption") | (F.abs(F.lag("size").over(at) - F.col("size")) > 1) | (gap > 0.8 * F.col("size"))
    rows = lines.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_block", F.sum("_new").over(at))
    of = rows.groupBy("doc_id", "page", "_block").agg(F.min("type").alias("block_type"), F.min("level").alias("level"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_no", "text"))), lambda x: x["text"]), "\n").alias("_t"))
    text = F.replace(F.regexp_replace("_t", r"(\p{Ll})-\n(\p{Ll})", "$1$2"), F.lit("\n"), F.lit(" "))
    order = Window.partitionBy("doc_id").orderBy("page", "_block")
    return of.select("doc_id", "page", (F.row_number().over(order) - 1).alias("block_index"), "block_type", "level", text.alias("text"), F.array("x0", "top", "x1", "bottom").alias("bounding_box"))


def heading_paths(rows: DataFrame) -> DataFrame:
    """rows with heading_path: the open headings above each block, outermost first.

    rows has doc_id, block_index, block_type, level, text. The last heading of each level counts until one of its
    level or above follows: running maxima of places, so a document needs no fold.
    """
    at = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("block_type").isin("heading", "title")
    level = F.when(F.col("block_type") == "title", 0).otherwise(F.least(F.coalesce("level", F.lit(1)), F.lit(4)))
    out = rows
    for n in range(5):
        out = out.withColumn(f"_h{n}", F.max(F.when(head & (level == n), F.struct("block_index", "text"))).over(at))
    parts = []
    for n in range(5):
        above = F.lit(-1)
        for m in range(n):
            above = F.greatest(above, F.coalesce(F.col(f"_h{m}.block_index"), F.lit(-1)))
        parts.append(F.when(F.col(f"_h{n}.block_index") > above, F.col(f"_h{n}.text")))
    return out.withColumn("heading_path", F.array_compact(F.array(*parts))).drop(*[f"_h{n}" for n in range(5)])


def captions_of(assets: DataFrame, captions: DataFrame) -> DataFrame:
    """asset_id, caption: the caption nearest to an asset on its page, within 72 points: a range join and min_by."""
    a, c = assets.alias("a"), captions.alias("c")
    distance = F.greatest(F.col("c.top") - F.col("a.bottom"), F.col("a.top") - F.col("c.bottom"), F.lit(0.0))
    near = a.join(c, (F.col("a.doc_id") == F.col("c.doc_id")) & (F.col("a.page") == F.col("c.page")) & (distance <= NEAR))
    return near.groupBy(F.col("a.asset_id").alias("asset_id")).agg(F.min_by(F.col("c.text"), F.struct(distance, F.col("c.text"))).alias("caption"))


def element_id(doc_id: Column, page: Column, kind: Column, text: Column) -> Column:
    return F.concat(F.lit("el-"), F.substring(F.sha2(F.concat_ws("\x1f", doc_id.cast("string"), page.cast("string"), kind, text), 256), 1, 20))
