"""Content profiles: json, prose or verse, by line statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T

# Words in file names that hint at a profile
VERSE_NAMES = (
    "poema|poesía|verso|estrofa|poeta|poem|poetry|verse|stanza|lyric|canción|canciones|song|soneto|sonnet"
)
PROSE_NAMES = (
    "libro|capítulo|book|chapter|novela|novel|ensayo|essay|artículo|article|documento|texto|text|escrito|writing|manual|guía|guide"
)
JSON_NAMES = r"(?i)\.(json|ndjson|jsonl)$"


def name_hint(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return F.when(name.rlike(VERSE_NAMES), "verso").when(name.rlike(PROSE_NAMES), "prosa")


def line_stats(df: DataFrame, text: str, sample: int = 100, short: int = 180, very_short: int = 100) -> DataFrame:
    """Adds ``stats``: shares and counts over the first ``sample`` lines."""
    df = df.withColumn("_lines", F.transform(F.slice(F.split(text, "\n"), 1, sample), T.strip))
    df = df.withColumn("_full", F.filter("_lines", lambda x: x != ""))
    n = F.size("_full")
    share = lambda f: F.coalesce(F.size(F.filter("_full", f)) / F.nullif(n, F.lit(0)), F.lit(0.0))
    is_short = lambda x: (x != "") & (F.length(x) <= short)
    runs = F.size(F.filter(F.transform("_lines", lambda x, i: is_short(x) & F.when(i == 0, True).otherwise(~is_short(F.get("_lines", i - 1)))), lambda b: b))
    stats = F.struct(
        F.size("_lines").alias("lines"),
        n.alias("full"),
        share(lambda x: F.length(x) <= short).alias("short"),
        share(lambda x: F.length(x) <= very_short).alias("very_short"),
        ((F.size("_lines") - n) / F.size("_lines")).alias("blank"),
        runs.alias("groups"),
        F.coalesce(F.aggregate("_full", F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("avg_length"),
    )
    return df.withColumn("stats", stats).drop("_lines", "_full")


def classify(df: DataFrame, hint: Column | None = None, path: Column | None = None) -> DataFrame:
    """Adds ``profile`` and ``confidence`` from ``stats``; a json path decides at once."""
    hint = F.lit(None).cast("string") if hint is None else hint
    s = F.col("stats")
    marks = [(s["short"] >= 0.8, 0.4), (s["very_short"] >= 0.6, 0.3), (s["blank"] > 0.005, 0.2), (s["groups"] >= 2, 0.1)]
    score = F.round(sum((F.when(m, F.lit(w)).otherwise(F.lit(0.0)) for m, w in marks), F.lit(0.0)), 6)
    met = sum((m.cast("int") for m, _ in marks), F.lit(0))
    verse_hint = F.coalesce(hint == "verso", F.lit(False))
    strong = (s["short"] >= 0.8).cast("int") + (s["very_short"] >= 0.7).cast("int") + (s["avg_length"] <= 150).cast("int") + verse_hint.cast("int")
    few = s["full"] < 5
    verse = (score >= 0.8) & (met >= 2)
    profile = F.when(few, F.coalesce(hint, F.lit("prosa"))).when(verse | (strong >= 2), "verso").otherwise("prosa")
    sure = F.when(few, 0.4).when(verse, score).when(strong >= 2, F.least(F.lit(0.85), F.round(0.6 + 0.1 * strong, 6)))
    sure = sure.when(F.coalesce(hint == "prosa", F.lit(False)), 0.8).when(verse_hint, 0.6).otherwise(0.7)
    if path is not None:
        sure = F.when(path.rlike(JSON_NAMES), 1.0).otherwise(sure)
        profile = F.when(path.rlike(JSON_NAMES), "json").otherwise(profile)
    return df.withColumn("profile", profile).withColumn("confidence", sure.cast("double"))


def detect(df: DataFrame, text: str, path: Column | None = None) -> DataFrame:
    """Profile and report of each document; empty text goes by its name, at 0.5, or is prose at 0.3."""
    hint = F.lit(None).cast("string") if path is None else name_hint(path)
    out = classify(line_stats(df, text), hint, path)
    empty = T.strip(F.col(text)) == ""
    out = out.withColumn("confidence", F.when(empty, F.when(hint.isNotNull(), 0.5).otherwise(0.3)).otherwise(F.col("confidence")))
    out = out.withColumn("profile", F.when(empty, F.coalesce(hint, F.lit("prosa"))).otherwise(F.col("profile")))
    return out.withColumn("report", F.struct("profile", "confidence", "stats"))


def accepted(df: DataFrame, least: float = 0.35, manual: str = "prosa") -> DataFrame:
    """Below the threshold the manual choice holds."""
    return df.withColumn("profile", F.when(F.col("confidence") >= least, F.col("profile")).otherwise(F.lit(manual)))


# What a numbered line begins with
NUMBERING = {
    "arabic": r"^[0-9]+[.)]",
    "roman": r"^[IVXLCDM]+[.)]",
    "letter": r"^[a-zA-Z][.)]",
    "decimal": r"^[0-9]+\.[0-9]+",
    "bullet": r"^[-*•]",
}


def numbering(lines: DataFrame, line: str) -> DataFrame:
    """(pattern, n) of lines that begin like each kind of numbering, in one pass."""
    kinds = F.array(*[F.when(F.col(line).rlike(p), F.lit(k)) for k, p in NUMBERING.items()])
    return lines.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def numbering_report(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """Per document and pattern: occurrences, first ten line numbers, five examples."""
    kinds = F.array(*[F.when(F.col(line).rlike(p), F.lit(k)) for k, p in NUMBERING.items()])
    e = lines.select(doc, pos, line, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("pattern"))
    g = e.groupBy(doc, "pattern").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(pos, line))).alias("_all"))
    return g.select(doc, "pattern", "n", F.slice(F.col(f"_all.{pos}"), 1, 10).alias("lines"), F.slice(F.col(f"_all.{line}"), 1, 5).alias("examples"))


def content_type(df: DataFrame, text: str) -> DataFrame:
    """Adds ``content_type``: biblical_text, poetry, continuous_prose, mixed_content or empty."""
    df = df.withColumn("_l", F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != ""))
    n = F.size("_l")
    numbered = F.size(F.filter("_l", lambda x: x.rlike(r"^[0-9]+[.: ]")))
    avg = F.aggregate("_l", F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(n, F.lit(0))
    kind = F.when(n == 0, "empty").when(numbered > 0.3 * n, "biblical_text").when(avg < 60, "poetry").when(avg > 120, "continuous_prose").otherwise("mixed_content")
    return df.withColumn("content_type", kind).drop("_l")


def samples(c: Column, ends: int = 5) -> Column:
    """The first and last ``ends`` non-empty lines, or all where there are no more than twice as many."""
    full = F.filter(F.transform(F.split(c, "\n"), T.strip), lambda x: x != "")
    return F.when(F.size(full) > 2 * ends, F.concat(F.slice(full, 1, ends), F.slice(full, -ends, ends))).otherwise(full)
