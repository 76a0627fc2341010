"""Processing jobs: results, timings, errors, their log and their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The steps of a processing job and the progress at which each begins
STEPS = (("pending", 0), ("validate", 5), ("load", 10), ("process", 20), ("segment", 50), ("import", 75), ("index", 85), ("finish", 95), ("completed", 100))


def by_result(runs: DataFrame, code: str) -> DataFrame:
    return runs.groupBy(F.col(code).alias("result_code")).agg(F.count(F.lit(1)).alias("n"))


def timing(runs: DataFrame, group: str, seconds: str) -> DataFrame:
    per_minute = F.count(F.lit(1)) / F.nullif(F.sum(seconds), F.lit(0)) * 60
    return runs.groupBy(group).agg(F.avg(seconds).alias("avg_s"), F.min(seconds).alias("min_s"), F.max(seconds).alias("max_s"), per_minute.alias("per_minute"))


def extremes(runs: DataFrame, group: str, seconds: str, key: str) -> DataFrame:
    by = F.struct(seconds, key)
    return runs.groupBy(group).agg(F.min_by(key, by).alias("fastest"), F.max_by(key, by).alias("slowest"))


def error_share(errors: DataFrame, kind: str) -> DataFrame:
    n = errors.groupBy(F.col(kind).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def top_patterns(errors: DataFrame, kind: str, message: str, k: int = 10) -> DataFrame:
    pattern = F.concat(F.col(kind), F.lit(": "), F.left(message, F.lit(100)))
    return errors.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(k)


def by_extension(files: DataFrame, path: str) -> DataFrame:
    return files.groupBy(F.regexp_extract(path, r"\.[^./]+$", 0).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


# Error types that a log entry may name, the first of them counts, and the name of no file
ERROR_TYPES = ("NameError", "AttributeError", "TypeError", "FileNotFoundError", "PermissionError", "ValueError", "KeyError", "ImportError")
NO_FILE = "Desconocido"


def first_keyword(entry: Column, kinds: tuple[str, ...], other: str = "other") -> Column:
    """The first of ``kinds`` that stands in an entry."""
    out = F.lit(other)
    for k in reversed(kinds):
        out = F.when(F.contains(entry, F.lit(k)), k).otherwise(out)
    return out


def log_entries(logs: DataFrame, text: str, kinds: tuple[str, ...] = ERROR_TYPES) -> DataFrame:
    """(ts, file, error_type, message) of a log's entries: each begins at a line that starts with a time stamp and
    goes on to the next such line; what stands before the first is left out. The file is what ``para`` or ``para
    archivo`` names in the first line, up to a colon."""
    stamp = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})"
    e = logs.select(F.explode(F.split(text, r"\n(?=\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})")).alias("entry"))
    e = e.withColumn("entry", F.btrim("entry", F.lit(" \t\n\r\f\x0B"))).where(F.col("entry").rlike(stamp)).withColumn("_first", F.regexp_extract("entry", r"^([^\n]*)", 1))
    named = F.nullif(F.regexp_extract("_first", r"para (?:archivo )?([^:]+?)(?:\s*:|$)", 1), F.lit(""))
    return e.select(
        F.regexp_extract("entry", stamp, 1).alias("ts"), F.coalesce(named, F.lit(NO_FILE)).alias("file"), first_keyword(F.col("entry"), kinds).alias("error_type"),
        F.regexp_replace("entry", stamp + r"\s*", "").alias("message"),
    )


def latest(events: DataFrame, job: str, status: str, *order: str) -> DataFrame:
    """State of each job: the status of its last event."""
    return events.groupBy(F.col(job).alias("job")).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("steps"))


def progress(step: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in STEPS for x in pair]), step)
