"""Library queries: statistics, lists, filters and the joins behind the web views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T


def by_type(docs: DataFrame, kind: str) -> DataFrame:
    return docs.groupBy(F.col(kind).alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


def top_authors(docs: DataFrame, author: str, unknown: str = "Desconocido", k: int = 10) -> DataFrame:
    known = docs.where(F.col(author) != unknown).groupBy(F.col(author).alias("author")).agg(F.count(F.lit(1)).alias("n"))
    return known.orderBy(F.desc("n"), "author").limit(k)


def totals(docs: DataFrame, text: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(T.word_count(F.col(text))), F.lit(0)).alias("words"))


def page(docs: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return docs.orderBy(*order).offset(offset).limit(limit)


def search(docs: DataFrame, needle: str, *columns: str) -> DataFrame:
    """LIKE infix, case-insensitive, in any column; of a text only its preview is searched if the caller passes that."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{needle}%")
    return docs.where(hit)


def filtered(docs: DataFrame, search: str | None = None, columns: tuple[str, ...] = (), equal: dict | None = None, among: dict | None = None, status: str = "all", progress: str = "progress") -> DataFrame:
    """The list views' filters, all optional: an infix, equalities, sets of values, reading status."""
    if search:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(c), F.lit(search.lower()))
        docs = docs.where(hit)
    for c, v in (equal or {}).items():
        docs = docs.where(F.col(c) == v)
    for c, vs in (among or {}).items():
        docs = docs.where(F.col(c).isin(*vs))
    if status == "completed":
        docs = docs.where(F.col(progress) >= 100)
    elif status == "in-progress":
        docs = docs.where((F.col(progress) > 0) & (F.col(progress) < 100))
    return docs


def with_counts(docs: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Each document with the number of its rows in every child table, 0 where there are none."""
    for name, child in children.items():
        n = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        docs = docs.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return docs


def page_info(docs: DataFrame, page_no: int, limit: int) -> DataFrame:
    n = docs.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / limit).cast("long")
    return n.select("total", pages.alias("total_pages"), (F.lit(page_no) < pages).alias("has_next"), F.lit(page_no > 1).alias("has_prev"))


def reading_pages(words: Column, per_page: int = 250) -> Column:
    return F.greatest(F.ceil(words / per_page), F.lit(1)).cast("long")


def author_matches(author: Column, wanted: list[str]) -> Column:
    """An author filter: either name contains the other, case-insensitive."""
    a = F.lower(author)
    hit = F.lit(False)
    for w in wanted:
        hit = hit | F.contains(a, F.lit(w.lower())) | F.contains(F.lit(w.lower()), a)
    return hit


def notes_containing(sections: DataFrame, notes: str, query: str) -> DataFrame:
    """Sections with only those notes (array of struct title, content) that contain ``query``; empty ones go."""
    q = F.lit(query.lower())
    kept = F.filter(notes, lambda n: F.contains(F.lower(n["title"]), q) | F.contains(F.lower(n["content"]), q))
    return sections.withColumn(notes, kept).where(F.size(notes) > 0)


def recent(opened: DataFrame, key: str, at: str, k: int = 10) -> DataFrame:
    """The k keys opened last, each once."""
    return opened.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key).limit(k)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of those of equal key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)
