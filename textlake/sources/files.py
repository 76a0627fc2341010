"""File sources: text, Markdown, NDJSON, JSON, CSV and HTML as DataFrames, DOCX and XLSX as data sources."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from textlake.functions import text as T
from textlake.operators import rules, segment
from textlake.shipping import ship
from textlake.sources import pdf


def whole(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, text): files below ``path``, one row each; a file of any size is one row."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, bytes) of the files below a folder, by path; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy("path")


def text_blocks(files: DataFrame) -> DataFrame:
    """(path, pos, block): blank-line separated blocks, line ends unified."""
    return files.select("path", F.posexplode(segment.blocks(F.col("text"))).alias("pos", "block"))


def markdown_blocks(files: DataFrame, whole_if: str | None = None) -> DataFrame:
    """As ``text_blocks`` with runs of blank lines collapsed; files whose path has ``whole_if`` stay one block."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(T.unix_lines(F.col("text")), r"\n{3,}", "\n\n"), "\n\n"), T.strip), lambda b: b != "")
    if whole_if:
        parts = F.when(F.contains("path", F.lit(whole_if)), F.array(T.strip(F.col("text")))).otherwise(parts)
    return files.select("path", F.posexplode(parts).alias("pos", "block"))


def front_matter(c: Column) -> tuple[Column, Column]:
    """(map of its ``key: value`` lines, the text after it) of a Markdown text."""
    head = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda l: F.struct(T.strip(F.regexp_extract(l, r"^([^:]+):", 1)).alias("key"), T.strip(F.regexp_replace(l, r"^[^:]*:", "")).alias("value"))), lambda p: p["key"] != "")
    return F.map_from_entries(pairs), F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n", "")


def markdown_title(c: Column, given: Column | None = None) -> Column:
    """The title given, else the first heading of level one; only line feeds end its line."""
    first = F.nullif(T.strip(F.regexp_extract(c, r"(?dm)^[ \t]*#[ \t]+(.+)$", 1)), F.lit(""))
    return first if given is None else F.coalesce(given, first)


def typed_markdown(files: DataFrame) -> DataFrame:
    """(path, pos, kind, block): headings by ``#``, poem titles in asterisks, and paragraphs between them."""
    l = segment.lines(files, "path", "text").withColumn("line", T.strip(F.col("line")))
    kind = F.when(F.col("line").rlike("^#"), F.concat(F.lit("title_level_"), segment.heading_level(F.col("line"))))
    kind = kind.when(F.col("line").rlike(r"^\*\*[^*]+\*\*$"), "poem_title").when(F.col("line") == "", "blank").otherwise("paragraph")
    w = Window.partitionBy("path").orderBy("pos")
    l = l.withColumn("kind", kind).withColumn("_last", F.lag("kind").over(w))
    l = l.withColumn("run", F.sum(F.when((F.col("kind") == "paragraph") & F.col("_last").eqNullSafe("paragraph"), 0).otherwise(1)).over(w)).where("kind <> 'blank'")
    g = l.groupBy("path", "run").agg(F.min("pos").alias("pos"), F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    return g.select("path", "pos", "kind", F.array_join(F.col("_l.line"), " ").alias("block"))


def looks_like_poetry(c: Column) -> Column:
    """At least two of: short lines, a poem's form word, lines without end marks, many short sentences."""
    l = F.filter(F.split(c, "\n"), lambda x: T.strip(x) != "")
    avg = F.aggregate(l, F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(F.size(l), F.lit(0))
    open_end = F.size(F.filter(l, lambda x: ~x.rlike(r"[.!?]\s*$"))) > 0.5 * F.size(l)
    s = F.filter(F.split(c, "[.!?]"), lambda x: T.strip(x) != "")
    brief = F.size(F.filter(s, lambda x: F.length(T.strip(x)) < 50)) > 0.3 * F.size(s)
    marks = [avg < 60, c.rlike(r"(?i)\b(poema|verso|estrofa|soneto|canto)\b"), open_end, brief]
    return sum((F.coalesce(m, F.lit(False)).cast("int") for m in marks), F.lit(0)) >= 2


def verse_lines(c: Column) -> Column:
    """Line breaks set back where a comma or end mark runs into a capital, if that makes over three lines."""
    broken = F.regexp_replace(c, rf"([,;:.!?])\s+(?=[{segment.CAPITAL}])", "$1\n")
    return F.when(F.regexp_count(broken, F.lit("\n")) - F.regexp_count(c, F.lit("\n")) > 3, broken).otherwise(c)


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Records of NDJSON files with their file and line; lines that are not JSON are left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_id"), "value")
    raw = raw.withColumn("doc", rules.parsed(F.col("value"))).where("doc IS NOT NULL")
    return rules.records(raw, "doc").drop("_id", "value")


def json_objects(files: DataFrame, root: str | None = None, single: bool = False) -> DataFrame:
    return rules.items(files.withColumn("doc", rules.parsed(F.col("text"))).where("doc IS NOT NULL"), "doc", root, single)


def folder(paths: DataFrame, path: str, base: str = "") -> DataFrame:
    """(name, is_dir, files, position): what lies in the folder ``base``, sub-folders first, then by name."""
    inside = paths.where(F.startswith(path, F.lit(base))).select(F.expr(f"substring({path}, {len(base) + 1})").alias("_rest")).where("_rest <> ''")
    names = inside.groupBy(F.regexp_extract("_rest", r"^([^/]*)", 1).alias("name")).agg(F.bool_or(F.contains("_rest", F.lit("/"))).alias("is_dir"), F.count(F.lit(1)).alias("files"))
    return names.withColumn("position", F.row_number().over(Window.orderBy(F.desc("is_dir"), "name")))


def delimiter(sample: str) -> str:
    """The commonest of comma, semicolon, tab and bar in the first 1,024 characters; ties in that order, none: comma."""
    return max([",", ";", "\t", "|"], key=sample[:1024].count)


def csv_blocks(files: DataFrame) -> DataFrame:
    """(path, pos, block): rows of CSV texts (path, text) by their own delimiter and header, as ``column: value;
    column: value``; empty cells and rows are left out, nameless columns numbered. A text is read where it lies."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, text in zip(part["path"], part["text"]):
                rows = list(csv.reader(io.StringIO(text or ""), delimiter=delimiter(text or "")))
                names = clean_names(rows[0]) if rows else []
                for i, row in enumerate(rows[1:]):
                    block = "; ".join(f"{n}: {v.strip()}" for n, v in zip(names, row) if v.strip())
                    if block:
                        out.append((path, i, block))
            yield pd.DataFrame(out, columns=["path", "pos", "block"])

    ship(files.sparkSession)
    return files.select("path", "text").mapInPandas(run, f"path {files.schema['path'].dataType.simpleString()}, pos int, block string")


def office(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content) of binary files on any storage that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")


def _parsed_files(files: DataFrame, parse, columns: list[str], schema: str, failed) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    out += [(path, *row) for row in parse(bytes(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
                    out.append((path, *failed(e)))
            yield pd.DataFrame(out, columns=columns)

    ship(files.sparkSession)
    return files.mapInPandas(run, schema)


def docx_files(files: DataFrame) -> DataFrame:
    """Paragraphs of DOCX files (path, content); a file that can't be read is one paragraph of style ``error``."""
    columns = ["path", "pos", "text", "style", "bold", "centred"]
    return _parsed_files(files, docx_paragraphs, columns, DocxSource.columns, lambda e: (0, f"{type(e).__name__}: {e}", "error", False, False))


def docx_properties(files: DataFrame) -> DataFrame:
    """(path, title, author, created, modified, subject, keywords) from the core properties of DOCX files; nulls
    where a file has none."""
    return _parsed_files(files, core_properties, ["path", *CORE], "path string, " + ", ".join(f"{c} string" for c in CORE), lambda e: (None,) * len(CORE))


def docx_markdown(files: DataFrame) -> DataFrame:
    """(path, text): DOCX files as Markdown, headings by their level, paragraphs apart by a blank line."""
    p = docx_headings(docx_files(files))
    line = F.when(F.col("is_heading"), F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    g = p.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("_l"))
    return g.select("path", F.array_join("_l.line", "\n\n").alias("text"))


def pdf_files(files: DataFrame) -> DataFrame:
    """(path, page, pos, text, size): the lines of PDF files (path, content) with their font size; a file that can't
    be read is one line of page 0. A file is read where it lies."""
    return _parsed_files(files, pdf.lines, ["path", "page", "pos", "text", "size"], "path string, page int, pos int, text string, size double", lambda e: (0, 0, f"{type(e).__name__}: {e}", 0.0))


def pdf_properties(files: DataFrame) -> DataFrame:
    """(path, title, author, date, n_pages) of PDF files."""
    return _parsed_files(files, pdf.properties, ["path", "title", "author", "date", "n_pages"], "path string, title string, author string, date string, n_pages int", lambda e: (None, None, None, 0))


def pdf_markdown(files: DataFrame, larger: float = 1.2) -> DataFrame:
    """(path, text): PDF files as Markdown: lines over ``larger`` times their file's average type are headings, pages
    are apart by a blank line."""
    p = pdf_files(files).withColumn("_avg", F.avg("size").over(Window.partitionBy("path")))
    line = F.when(F.col("size") > F.col("_avg") * larger, F.concat(F.lit("## "), F.col("text"))).otherwise(F.col("text"))
    pages = p.groupBy("path", "page").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("_l"))
    g = pages.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page", F.array_join("_l.line", "\n").alias("t")))).alias("_p"))
    return g.select("path", F.array_join("_p.t", "\n\n").alias("text"))


def xlsx_files(files: DataFrame) -> DataFrame:
    """Blocks of XLSX files (path, content); a file or sheet that can't be read is one block of kind ``error``."""
    parse = lambda data: sheet_blocks(list(xlsx_rows(data)))
    return _parsed_files(files, parse, ["path", "sheet", "pos", "kind", "block"], XlsxSource.columns, lambda e: ("", 0, "error", f"{type(e).__name__}: {e}"))


def csv_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(row, block): each row of a table as ``column: value; column: value``, empty cells and rows out."""
    names = names or df.columns
    cells = [F.when(T.strip(F.col(f"`{c}`").cast("string")) != "", F.concat(F.lit(f"{n}: "), T.strip(F.col(f"`{c}`").cast("string")))) for c, n in zip(df.columns, names)]
    return df.select(F.concat_ws("; ", *cells).alias("block")).where("block <> ''").withColumn("row", F.monotonically_increasing_id())


def clean_names(names: list[str]) -> list[str]:
    """Column names of a sheet; nameless ones are numbered."""
    return [n.strip() if n and n.strip() and not n.startswith("Unnamed") else f"Columna_{i}" for i, n in enumerate(names, 1)]


def header_row(rows: list[list[str]]) -> int:
    """Where over 70 % of the first row's cells have no name, the first of five rows at least half full."""
    if rows and sum(not c or c.startswith("Unnamed") for c in rows[0]) > 0.7 * max(1, len(rows[0])):
        return next((i for i, r in enumerate(rows[:5]) if sum(bool(c) for c in r) >= 0.5 * max(1, len(r))), 0)
    return 0


def html_title(c: Column) -> Column:
    return T.squeeze(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(c: Column) -> Column:
    """Markdown-like text: scripts, styles and comments out, headings as ``#``, blocks as lines, entities back."""
    t = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<head[^>]*>.*?</head>", " ")
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{n}[^>]*>", "\n" + "#" * n + " ")
    t = F.regexp_replace(t, r"(?is)<li[^>]*>", "\n* ")
    t = F.regexp_replace(t, r"(?is)<br\s*/?>|</?(p|div|h[1-6]|ul|ol|table|tr|section|article|header|footer|nav|main|body|html|blockquote)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    rows = F.filter(F.transform(F.split(t, "\n"), T.squeeze), lambda x: x != "")
    return F.array_join(rows, "\n")


def source_folder(path: Column) -> Column:
    """The folder after ``fuentes`` in a path, else the parent folder."""
    named = F.regexp_extract(path, r"/fuentes/([^/]+)/", 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1))


# ---- scanned pages: what decides on OCR, and blocks from its lines


def needs_ocr(blocks: DataFrame, doc: str, text: str) -> DataFrame:
    """Before segmentation: at least 70 % control characters, or three blocks or fewer."""
    bad = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}]"))
    s = blocks.groupBy(doc).agg(F.count(F.lit(1)).alias("blocks"), F.sum(bad).alias("bad"), F.sum(F.length(text)).alias("chars"))
    return s.withColumn("ocr", (F.col("blocks") <= 3) | (F.col("bad") / F.greatest("chars", F.lit(1)) >= 0.7))


def needs_ocr_after(n_segments: Column, n_pages: Column) -> Column:
    return (n_segments <= 3) | ((n_pages >= 20) & (n_segments / n_pages < 0.1))


def ocr_title(c: Column) -> Column:
    t = T.strip(c)
    return (F.length(t).between(3, 80)) & ~t.rlike("[.,;]$") & (T.is_upper(t) | t.rlike(r"(?i)^(capítulo|parte|poema|canto|prólogo)\b") | t.rlike(r"^(?:[IVXLCDM]+|\d+)\.?$"))


def ocr_blocks(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """Lines of a scan into headings and paragraphs: a paragraph ends at a blank line, a title or an end mark."""
    w = Window.partitionBy(doc).orderBy(pos)
    l = lines.withColumn("_t", T.strip(F.col(line))).withColumn("kind", F.when(ocr_title(F.col(line)), "heading").otherwise("paragraph"))
    last, last_kind = F.lag("_t").over(w), F.lag("kind").over(w)
    begins = last.isNull() | (last == "") | (F.col("kind") == "heading") | (last_kind == "heading") | (last.rlike(r"[.!?]$") & F.col("_t").rlike(r"^\p{Lu}"))
    l = l.withColumn("run", F.sum(begins.cast("int")).over(w)).where("_t <> ''")
    g = l.groupBy(doc, "run").agg(F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct(pos, "_t"))).alias("_s"))
    return g.select(doc, F.col("run").alias("pos"), "kind", F.array_join(F.col("_s._t"), " ").alias("block"))


def first_answer(*providers: Column) -> Column:
    """The first provider's text that is not empty."""
    return F.coalesce(*[F.nullif(T.strip(p), F.lit("")) for p in providers])


# ---- office files by the standard library, as Python data sources

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_paragraphs(data: bytes) -> Iterator[tuple[int, str, str, bool, bool]]:
    """(pos, text, style, bold, centred) of each paragraph with text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    at = 0
    for p in root.iter(f"{_W}p"):
        text = re.sub(r"[ \t]+", " ", "".join(t.text or "" for t in p.iter(f"{_W}t"))).strip()
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        align = p.find(f"{_W}pPr/{_W}jc")
        runs = [r for r in p.iter(f"{_W}r") if r.find(f"{_W}t") is not None]
        bold = bool(runs) and all(r.find(f"{_W}rPr/{_W}b") is not None for r in runs)
        yield at, text, style.get(f"{_W}val", "") if style is not None else "", bold, align is not None and align.get(f"{_W}val") == "center"
        at += 1


# Core properties of an office file by our names
CORE = {"title": "title", "author": "creator", "created": "created", "modified": "modified", "subject": "subject", "keywords": "keywords"}


def core_properties(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = {}
        if "docProps/core.xml" in z.namelist():
            found = {e.tag.rsplit("}", 1)[-1]: (e.text or "").strip() for e in ElementTree.fromstring(z.read("docProps/core.xml"))}
    yield tuple(found.get(tag) or None for tag in CORE.values())


def xlsx_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for i, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
            title = sheet.get("name", "")
            target = targets.get(sheet.get(f"{_R}id"), f"worksheets/sheet{i}.xml").removeprefix("/xl/")
            path = f"xl/{target}"
            try:
                root = ElementTree.fromstring(z.read(path))
            except (KeyError, ElementTree.ParseError) as e:  # a bad sheet doesn't cost the others
                yield title, -1, [f"{type(e).__name__}: {e}"]
                continue
            for number, row in enumerate(root.iter(f"{_S}row")):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    if letters:
                        column = reduce(lambda n, x: n * 26 + ord(x) - 64, letters[0], 0) - 1
                        cells += [""] * (column - len(cells))
                    v = c.find(f"{_S}v")
                    value = v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                yield title, number, cells


def sheet_blocks(rows: list[tuple[str, int, list[str]]]) -> Iterator[tuple[str, int, str, str]]:
    """(sheet, pos, kind, block): a title, the header and each row as ``column: value | …``."""
    for sheet in dict.fromkeys(r[0] for r in rows):
        cells = [r[2] for r in rows if r[0] == sheet and r[1] >= 0]
        if bad := [r[2][0] for r in rows if r[0] == sheet and r[1] < 0]:
            yield sheet, 0, "error", bad[0]
            continue
        head = header_row(cells)
        names = clean_names(cells[head]) if cells else []
        yield sheet, 0, "title", sheet
        yield sheet, 1, "header", ", ".join(names)
        for i, row in enumerate(cells[head + 1 :], 2):
            block = " | ".join(f"{n}: {v}" for n, v in zip(names, row) if v and v.strip())
            if block:
                yield sheet, i, "row", block


class _OneFile(InputPartition):
    pass


class _OfficeReader(DataSourceReader):
    def __init__(self, paths: list[str], parse):
        self.paths, self.parse = paths, parse

    def partitions(self):
        return [_OneFile(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for row in self.parse(f.read()):
                yield (partition.value, *row)


class DocxSource(DataSource):
    """``format("docx")``: a partition a file; option ``paths``, separated by commas, on storage all machines see."""

    @classmethod
    def name(cls):
        return "docx"

    columns = "path string, pos int, text string, style string, bold boolean, centred boolean"

    def schema(self):
        return self.columns

    def reader(self, schema: StructType):
        return _OfficeReader(self.options["paths"].split(","), docx_paragraphs)


class XlsxSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    columns = "path string, sheet string, pos int, kind string, block string"

    def schema(self):
        return self.columns

    def reader(self, schema: StructType):
        return _OfficeReader(self.options["paths"].split(","), lambda data: sheet_blocks(list(xlsx_rows(data))))


def register(spark: SparkSession) -> None:
    for source in (DocxSource, XlsxSource):
        spark.dataSource.register(source)


def docx_headings(paragraphs: DataFrame) -> DataFrame:
    """Adds ``is_heading``, ``heading_level`` and ``page`` (four paragraphs each) to DOCX paragraphs."""
    styled = F.col("style").rlike("(?i)^(heading|title|ttulo|título)")
    p = paragraphs.withColumn("is_heading", styled | segment.is_heading(F.col("text"), F.col("bold") | F.col("centred")))
    level = F.coalesce(F.nullif(F.regexp_extract("style", r"(\d+)$", 1), F.lit("")).cast("int"), segment.heading_level(F.col("text")))
    return p.withColumn("heading_level", F.when(F.col("is_heading"), level)).withColumn("page", F.floor(F.col("pos") / 4).cast("int") + 1)


# Which reader a file's suffix means
SUFFIXES = {".txt": "text", ".md": "markdown", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson", ".csv": "csv", ".tsv": "csv", ".html": "html", ".htm": "html", ".docx": "docx", ".xlsx": "xlsx", ".pdf": "pdf"}
READERS: dict = {
    "csv": lambda s, p: csv_blocks(whole(s, p)), "docx": lambda s, p: docx_files(office(s, p, "*.docx")), "xlsx": lambda s, p: xlsx_files(office(s, p, "*.xlsx")),
    "pdf": lambda s, p: pdf_files(office(s, p, "*.pdf")),
    "text": lambda s, p: text_blocks(whole(s, p)), "markdown": lambda s, p: markdown_blocks(whole(s, p)), "ndjson": ndjson, "json": lambda s, p: json_objects(whole(s, p)), "html": lambda s, p: whole(s, p).withColumn("text", html_text(F.col("text"))),
}


def register_reader(suffix: str, name: str, f) -> None:
    """A reader is a function of (session, path) to a DataFrame."""
    SUFFIXES[suffix], READERS[name] = name, f


def reader_for(path: str):
    suffix = re.search(r"\.[A-Za-z0-9]+$", path)
    return READERS.get(SUFFIXES.get(suffix[0].lower() if suffix else "", ""))
