"""Hash registry: who has been seen, when, and what is a copy of it.

A registry is a table (hash, file_path, title, first_seen).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def first_seen(docs: DataFrame, text: str, *order: str) -> DataFrame:
    """Adds ``hash`` and ``is_new``: the first row of each hash, by ``order``, is the one registered.

    The first of each hash is an aggregate, joined back, so that many copies never meet in one window.
    """
    d = docs.withColumn("hash", content_hash(F.col(text)))
    lead = d.groupBy("hash").agg(F.min(F.struct(*order)).alias("_first"))
    return d.join(lead, "hash").withColumn("is_new", F.struct(*order) == F.col("_first")).drop("_first")


def unseen(batch: DataFrame, registry: DataFrame) -> DataFrame:
    return batch.join(registry.select("hash").distinct(), "hash", "left_anti")


def register(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """The registry after ``batch`` (hash, file_path, title, first_seen): hashes already there stay as they are."""
    fresh = unseen(batch, registry).groupBy("hash").agg(F.min_by(F.struct("file_path", "title", "first_seen"), F.struct("first_seen", "file_path")).alias("_r"))
    stem = F.regexp_replace(F.regexp_extract("_r.file_path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    fresh = fresh.select("hash", "_r.file_path", F.coalesce("_r.title", stem).alias("title"), "_r.first_seen")
    return registry.select("hash", "file_path", "title", "first_seen").unionByName(fresh)


def duplicates(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(hash, key, copy_of, n_copies) of each row that is not the first of its hash."""
    d = docs.select(key, content_hash(F.col(text)).alias("hash"))
    groups = d.groupBy("hash").agg(F.min(key).alias("copy_of"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return d.join(groups, "hash").where(F.col(key) != F.col("copy_of"))


def listed(registry: DataFrame, search: str | None = None, before: str | None = None, after: str | None = None, limit: int | None = None, offset: int = 0, largest: int = 1000) -> DataFrame:
    """Newest first; ``search`` is a LIKE infix of title or path; a limit of 0 or None means none."""
    r = registry
    if search:
        r = r.where(F.col("title").ilike(f"%{search}%") | F.col("file_path").ilike(f"%{search}%"))
    if before:
        r = r.where(F.col("first_seen") < F.lit(before).cast("timestamp"))
    if after:
        r = r.where(F.col("first_seen") > F.lit(after).cast("timestamp"))
    r = r.orderBy(F.desc("first_seen"), "hash")
    if offset:
        r = r.offset(offset)
    return r.limit(min(limit, largest)) if limit else r


def stats(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count(F.lit(1)).alias("total"), F.min("first_seen").alias("oldest"), F.max("first_seen").alias("newest"))


def pruned(registry: DataFrame, before: str) -> DataFrame:
    return registry.where(F.col("first_seen") >= F.lit(before).cast("timestamp"))


def without(registry: DataFrame, doomed: DataFrame, on: str = "hash") -> DataFrame:
    return registry.join(doomed.select(on).distinct(), on, "left_anti")


def delete_report(registry: DataFrame, wanted: DataFrame, on: str = "hash") -> DataFrame:
    """For each requested key, whether it was there to delete."""
    there = registry.select(on).distinct().withColumn("_there", F.lit(True))
    return wanted.select(on).distinct().join(there, on, "left").select(on, F.when(F.col("_there"), "deleted").otherwise("not_found").alias("outcome"))


def missing_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).exceptAll(right.select(key)).distinct()


def distinct_texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(norm_hash, key, n) by the hash of the text in lower case with squeezed white space."""
    norm = F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")))
    return docs.select(key, content_hash(norm).alias("norm_hash")).groupBy("norm_hash").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n"))
