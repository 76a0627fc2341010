"""Reader views: pages, contents, progress, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T


def progress(rows: DataFrame, doc: str, pos: str) -> DataFrame:
    w = Window.partitionBy(doc)
    return rows.withColumn("progress", F.round(F.row_number().over(w.orderBy(pos)) * 100.0 / F.count(F.lit(1)).over(w), 4))


def pages(segments: DataFrame, doc: str, pos: str, text: str, kind: str | None = None, per_page: int = 500) -> DataFrame:
    """Adds ``page_no``: segments are packed in order, at most ``per_page`` words a page; a heading begins a
    page; a larger segment has a page of its own. A fold over the document's word counts."""
    heading = F.lit(False) if kind is None else F.col(kind).rlike("^(heading|title_level_)")
    s = segments.withColumn("_w", T.word_count(F.col(text))).withColumn("_h", heading)
    order = s.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(pos, "_w", "_h"))).alias("_s"))

    def step(acc: Column, x: Column) -> Column:
        begins = (acc["words"] >= 0) & (x["_h"] | (acc["words"] + x["_w"] > per_page)) & (F.size(acc["out"]) > 0)
        page = F.when(begins, acc["page"] + 1).otherwise(acc["page"])
        words = F.when(begins, x["_w"]).otherwise(acc["words"] + x["_w"])
        return F.struct(page.alias("page"), words.alias("words"), F.concat(acc["out"], F.array(F.struct(x[pos].alias("pos"), page.alias("page")))).alias("out"))

    pos_type = segments.schema[pos].dataType.simpleString()
    zero = F.struct(F.lit(1).alias("page"), F.lit(0).alias("words"), F.array().cast(f"array<struct<pos:{pos_type},page:int>>").alias("out"))
    folded = order.select(doc, F.explode(F.aggregate("_s", zero, step, lambda a: a["out"])).alias("_o"))
    numbers = folded.select(doc, F.col("_o.pos").alias(pos), F.col("_o.page").alias("page_no"))
    return segments.join(numbers, [doc, pos])


def page_ranges(paged: DataFrame, doc: str, pos: str, words: Column) -> DataFrame:
    return paged.groupBy(doc, "page_no").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.sum(words).alias("words"))


def contents(paged: DataFrame, doc: str, pos: str, kind: str, title: str) -> DataFrame:
    """Table of contents: headings with level and page; the page number is carried, so no range join."""
    level = F.when(F.col(kind).rlike("chapter"), 1).when(F.col(kind).rlike("section"), 2)
    level = level.when(F.col(kind).rlike("title_level_"), F.regexp_extract(kind, r"title_level_(\d+)", 1).cast("int")).otherwise(1)
    return paged.where(F.col(kind).rlike("^(heading|title_level_|chapter|section)")).select(doc, pos, F.col(title).alias("title"), level.alias("level"), "page_no")


def visual_pages(segments: DataFrame, doc: str, text: str, lines: int = 30, columns: int = 80) -> DataFrame:
    return segments.groupBy(doc).agg(F.ceil(F.sum(F.length(text)) / (lines * columns)).cast("long").alias("visual_pages"))


def locate(text: Column, selection: Column) -> Column:
    """0-based place of a selection in a text, white space normalised on both sides; -1 if absent."""
    return F.locate(T.squeeze(selection), T.squeeze(text)) - 1 if isinstance(selection, str) else F.call_function("locate", T.squeeze(selection), T.squeeze(text)) - 1


def with_notes(segments: DataFrame, notes: DataFrame, segment: str, order: str) -> DataFrame:
    """Each segment with its annotations in order, an empty list where it has none."""
    n = notes.groupBy(segment).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in notes.columns if c not in (segment, order)]))).alias("notes"))
    return segments.join(n, segment, "left").withColumn("n_notes", F.coalesce(F.size("notes"), F.lit(0)))


def annotate(text: Column, spans: Column) -> Column:
    """Wraps spans (sorted array of struct start, size; not overlapping) in marks, from the last to the first."""
    def step(acc: Column, s: Column) -> Column:
        a = F.substring(acc, F.lit(1), s["start"])
        b = F.substring(acc, s["start"] + 1, s["size"])
        return F.concat(a, F.lit("<mark>"), b, F.lit("</mark>"), F.substring(acc, s["start"] + s["size"] + 1, F.length(acc)))

    return F.aggregate(F.reverse(spans), text, step)
