"""Record shapes, writers and the union of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import clean

UNREADABLE = "[text unreadable in its source]"
GENERIC_KEYS = ("title", "author", "language", "date")


def generic(segments: DataFrame, text: str, kind: str, order: str, title: Column | None = None, author: Column | None = None) -> DataFrame:
    """(text, type, order, title, author): the short record; an order of 0 counts as none."""
    none = F.lit(None).cast("string")
    return segments.select(F.col(text).alias("text"), F.nullif(F.col(kind), F.lit("")).alias("type"), F.nullif(F.col(order), F.lit(0)).alias("order"), (none if title is None else title).alias("title"), (none if author is None else author).alias("author"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row, null fields left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def grouped_json(segments: DataFrame, doc: str, order: str) -> DataFrame:
    """One JSON object a document: its segments in order under ``segments``."""
    rest = [c for c in segments.columns if c != doc]
    g = segments.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("segments"))
    return g.select(doc, F.to_json(F.struct(doc, "segments")).alias("value"))


def kept_metadata(c: Column, keys: tuple[str, ...] = GENERIC_KEYS) -> Column:
    return F.map_filter(c, lambda k, v: k.isin(*keys) & v.isNotNull())


def prefixed(c: Column, main: tuple[str, ...], prefix: str = "doc_") -> Column:
    """Metadata that is not in the main record, under prefixed keys, nulls out."""
    return F.transform_keys(F.map_filter(c, lambda k, v: ~k.isin(*main) & v.isNotNull()), lambda k, v: F.concat(F.lit(prefix), k))


def safe_text(c: Column) -> Column:
    """Text as it is written: a placeholder where it is corrupt, control characters out."""
    return F.when(clean.extremely_corrupt(c), F.lit(UNREADABLE)).otherwise(clean.control_chars(c))


def output_name(path: Column, suffix: str = "ndjson") -> Column:
    """``stem_ext.suffix`` for a source path."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = T.clean_filename(F.regexp_replace(name, r"\.[^.]*$", ""))
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.concat(stem, F.when(ext != "", F.concat(F.lit("_"), ext)).otherwise(F.lit("")), F.lit(f".{suffix}"))


def write_ndjson(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def whole_documents(segments: DataFrame, doc: str, order: str, text: str, glue: str = "\n\n") -> DataFrame:
    """One row a document: its segments joined in order, their number and words."""
    g = segments.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_s"), F.count(F.lit(1)).alias("total_segments"))
    g = g.withColumn("full_content", F.array_join(F.col(f"_s.{text}"), glue))
    return g.select(doc, "total_segments", "full_content", T.word_count(F.col("full_content")).alias("word_count"))


def store(docs: DataFrame, segments: DataFrame, path: str) -> None:
    """The normalised store: a table of documents and one of segments."""
    docs.write.mode("append").parquet(f"{path}/documents")
    segments.write.mode("append").parquet(f"{path}/segments")


def index_documents(segments: DataFrame, docs: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Flat index records: the segment with its document's searchable columns."""
    return segments.join(docs.select(key, *columns), key)


def unified(**parts: DataFrame) -> DataFrame:
    """UNION ALL by name of sources, each row tagged with its source and that source's number."""
    out = None
    for i, (name, df) in enumerate(sorted(parts.items()), 1):
        df = df.withColumn("_source_file", F.lit(name)).withColumn("_file_index", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def valid_files(lines: DataFrame, path: str, line: str) -> DataFrame:
    """Files without a bad or missing JSON line: a bad line rejects its whole file."""
    good = F.try_parse_json(line).isNotNull() | (T.strip(F.col(line)) == "")
    v = lines.groupBy(path).agg(F.bool_and(good).alias("ok"), F.count_if(T.strip(F.col(line)) != "").alias("entries"))
    return v.where("ok AND entries > 0").select(path, "entries")


def numbered(lines: DataFrame, path: str, order: str) -> DataFrame:
    """Adds ``file_index`` and ``line_number``: files by name, lines by ``order``."""
    names = lines.select(path).distinct().withColumn("file_index", F.row_number().over(Window.orderBy(path)))  # a row a file
    w = Window.partitionBy(path).orderBy(order)
    return lines.withColumn("line_number", F.row_number().over(w)).join(names, path)


def summary(lines: DataFrame, path: str) -> DataFrame:
    n = lines.groupBy(path).agg(F.count(F.lit(1)).alias("entries"))
    return n.agg(F.count(F.lit(1)).alias("files"), F.sum("entries").alias("entries"), F.round(F.avg("entries"), 4).alias("per_file"))
