"""Files as rows: discovery, sniffing, decoding, and the text and tables of office formats.

Spark's binaryFile source lists and reads; what must look into bytes runs as Arrow-batched pandas functions, a file at
a time, so no task holds more than its files. The office formats are read with the standard library's zip and XML.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# What is read as documents, and which folders hold none.
EXTENSIONS = ("pdf", "docx", "pptx", "xlsx", "csv", "txt", "md", "json", "canvas", "py", "js", "ts", "html", "htm", "xml", "yaml", "yml", "rs", "go", "java", "c", "cpp")
SKIPPED = (".git", ".obsidian", ".trash", ".venv", "__pycache__", "node_modules")
SNIFFED, MOST_CONTROLS = 8192, 0.08
MOST_CSV_ROWS = 100_000
TABLES = "array<struct<sheet_name:string,rows:array<array<string>>,warnings:array<string>>>"


def looks_like_text(content: bytes) -> bool:
    """Whether the first 8 KiB hold no NUL and few control characters."""
    head = bytes(content[:SNIFFED])
    if b"\0" in head:
        return False
    controls = sum(b < 32 and b not in b"\t\n\r\f\b\x1b" for b in head)
    return not head or controls / len(head) < MOST_CONTROLS


def decode(content: bytes) -> str:
    """The text of bytes: by byte order mark, else UTF-8, else Latin-1, which fails for none."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            try:
                return content.decode(name)
            except UnicodeDecodeError:
                break
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def discover(spark: SparkSession, root: str, notes_only: bool = False, force_text: bool = False) -> DataFrame:
    """path, extension, length, modified_at, content_hash, content of the files below root that hold documents.

    Folders of tools are skipped, and with notes_only whatever begins with a dot and all but notes. Files of other
    kinds stay if they look like text (always with force_text).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    inside = F.substring(path, F.length(F.lit("/" + root.split("://")[-1].strip("/"))) + 1, F.lit(1_000_000))
    skipped = inside.rlike("/(?:" + "|".join(re.escape(x) for x in SKIPPED) + ")/")
    files = files.where(~skipped & (~inside.rlike(r"/\.") if notes_only else F.lit(True)))
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    known = F.col("extension").isin("md", "txt", "canvas") if notes_only else F.col("extension").isin(*EXTENSIONS)
    head = F.substring("content", 1, SNIFFED)
    kept = files.where(known | F.lit(force_text) | _is_text(head))
    return kept.select("path", "extension", "length", F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("content_hash"), "content")


@F.pandas_udf(BooleanType())
def _is_text(head: pd.Series) -> pd.Series:
    return head.map(looks_like_text)


def sniff_separator(text: str) -> str:
    """Of comma, tab, semicolon and bar the one that parts most lines into equally many fields."""
    lines = [x for x in text.splitlines()[:50] if x.strip()]

    def steady(sep: str) -> tuple[int, int]:
        counts = [len(next(csv.reader([x], delimiter=sep), [])) for x in lines]
        best = max(set(counts), key=lambda n: (counts.count(n), n)) if counts else 1
        return (counts.count(best) if best > 1 else 0, best)

    return max(",\t;|", key=steady)


def csv_tables(content: bytes) -> list[dict]:
    text, warnings = decode(content), []
    if not content.startswith(b"\xef\xbb\xbf") and text.encode("utf-8", "replace") != content and not content.startswith((b"\xff\xfe", b"\xfe\xff")):
        warnings.append("encoding_fallback")
    rows = []
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=sniff_separator(text)):
        if len(rows) == MOST_CSV_ROWS:
            warnings.append("row_limit_reached")
            break
        rows.append(row)
    while rows and not any(x.strip() for x in rows[-1]):
        rows.pop()
    return [{"sheet_name": None, "rows": rows, "warnings": warnings}] if rows else []


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _is_percent(code: str) -> bool:
    return "%" in re.sub(r'"[^"]*("|$)', "", re.sub(r"\\.", "", code))


def xlsx_tables(content: bytes) -> list[dict]:
    """A table for each sheet that holds something. A formula counts as its cached value; percentages are in points."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())

        def xml(name: str):
            return ElementTree.fromstring(z.read(name)) if name in names else None

        shared = [] if (s := xml("xl/sharedStrings.xml")) is None else ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in s]
        percent: set[int] = set()
        if (styles := xml("xl/styles.xml")) is not None:
            codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
            for i, xf in enumerate(styles.find(f"{MAIN}cellXfs") or []):
                n = int(xf.get("numFmtId", 0))
                if n in (9, 10) or _is_percent(codes.get(n, "")):
                    percent.add(i)
        links = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels") or []}
        out = []
        for sheet in (xml("xl/workbook.xml") or ElementTree.Element("x")).iter(f"{MAIN}sheet"):
            target = links.get(sheet.get(LINK), "").lstrip("/")
            body = xml(target if target.startswith("xl/") else f"xl/{target}")
            rows, warnings = [], []
            for row in [] if body is None else body.iter(f"{MAIN}row"):
                at = int(row.get("r", len(rows) + 1)) - 1
                while len(rows) <= at:
                    rows.append([])
                for cell in row.iter(f"{MAIN}c"):
                    value, kind = cell.find(f"{MAIN}v"), cell.get("t", "n")
                    text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) if kind == "inlineStr" else (value.text or "" if value is not None else "")
                    if kind == "s" and text:
                        text = shared[int(text)]
                    elif kind == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    elif kind == "n" and text and int(cell.get("s", 0)) in percent:
                        text = f"{round(float(text) * 100, 10):.10g}%"
                    if cell.find(f"{MAIN}f") is not None and value is None:
                        warnings.append("formula_cached_value_unavailable")
                    col = _column(cell.get("r", "A1"))
                    rows[at] += [""] * (col + 1 - len(rows[at]))
                    rows[at][col] = text
            while rows and not any(x.strip() for x in rows[-1]):
                rows.pop()
            if rows:
                out.append({"sheet_name": sheet.get("name"), "rows": rows, "warnings": sorted(set(warnings))})
        return out


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join((t.text or "") if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "" for t in p.iter()) for p in root.iter(f"{w}p"))


def pptx_text(content: bytes) -> str:
    a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        return "\n\n".join("\n".join("".join(t.text or "" for t in p.iter(f"{a}t")) for p in ElementTree.fromstring(z.read(n)).iter(f"{a}p")) for n in slides)


def html_text(text: Column) -> Column:
    """Text of HTML: without scripts, styles and tags; blocks part lines; the commonest references are undone."""
    out = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, ext, content in zip(batch["path"], batch["extension"], batch["content"], strict=True):
            text, tables, error, data = None, [], None, bytes(content)
            try:
                if ext == "xlsx":
                    tables = xlsx_tables(data)
                elif ext == "csv":
                    tables = csv_tables(data)
                elif ext == "docx":
                    text = docx_text(data)
                elif ext == "pptx":
                    text = pptx_text(data)
                elif looks_like_text(data):
                    text = decode(data)
                else:
                    error = "no_reader"
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, csv.Error) as e:
                error = f"failed: {e}"[:58]
            if tables:
                text = "\n\n".join("\n".join("\t".join(r) for r in t["rows"]) for t in tables)
            rows.append((path, text, tables, error))
        yield pd.DataFrame(rows, columns=["path", "text", "tables", "error"])


def extract(files: DataFrame) -> DataFrame:
    """path, extension, content_hash, text, tables, error of discovered files. A file that can't be read has an error, and stops none."""
    read = files.select("path", "extension", "content").mapInPandas(_extract, f"path string, text string, tables {TABLES}, error string")
    out = files.drop("content").join(read, "path")
    return out.withColumn("text", F.when(F.col("extension").isin("html", "htm"), html_text(F.col("text"))).otherwise(F.col("text")))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def append_vectors(df: DataFrame, path: str, dimension: int) -> None:
    """Appends vectors by source_kind. Columns that the table needs and df lacks, or vectors of another size, are refused."""
    need = {"id", "vector", "doc_id", "source_kind", "embedding_model_id"}
    if missing := need - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    wrong = F.raise_error(F.lit(f"a vector hasn't {dimension} dimensions")).cast("array<float>")
    df.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector").cast("array<float>")).otherwise(wrong)).write.mode("append").partitionBy("source_kind").parquet(path)
