"""Text, segmentation, profile, author, search, reader and source queries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import vector as V
from textlake.operators import authors, clean, jobs, profile, reader, rules, search, segment, settings
from textlake.plans import made_files, restated
from textlake.plans.registry import query
from textlake.shipping import ship
from textlake.sources import files, sinks
from textlake.streaming import incremental

WSQ = r"[ \t\n\r\f\v]"
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents"
STRIP = rf"regexp_replace(%s, '^{WSQ}+|{WSQ}+$', '', 'g')"


def _lines(t):
    return segment.lines(t("documents"), "doc_id", "text")


@query("STR-01", f"SELECT doc_id, lower(translate(text, '{T.ACCENTED}', '{T.FOLDED}')) AS folded FROM documents")
def accent_fold(t):
    return t("documents").select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


@query("STR-15", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def preview(t):
    return t("documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("AGG-19 AGG-22", rf"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS words, CAST(ceil(length(text) / 2400.0) AS BIGINT) AS visual_pages FROM documents")
def word_counts(t):
    d = t("documents")
    return d.select("doc_id", T.word_count(F.col("text")).cast("long").alias("words")).join(reader.visual_pages(d, "doc_id", "text"), "doc_id")


@query("STR-09 SNK-08", r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed_file') AS name FROM pages")
def clean_filenames(t):
    return t("pages").select("page_id", T.clean_filename(F.col("url")).alias("name"))


@query("STR-02 STR-22", "SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name_key FROM supplier")
def name_keys(t):
    return t("supplier").select("s_suppkey", T.name_key(F.col("s_name")).alias("name_key"))


@query("STR-10", "SELECT page_id, left(trim(regexp_replace(regexp_replace(url, '[<>|:*?\"\\\\/\\n\\r]', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 200) AS author FROM pages")
def author_overrides(t):
    return t("pages").select("page_id", T.author_override(F.col("url")).alias("author"))


@query("STR-03 STR-04")
def structural_keys(t):
    return t("benchmark").select("item_id", clean.structural_key(F.col("text")).alias("norm"))


@query("MAP-02 UDF-01 UDF-03 UDF-04 SRC-37")
def profile_segments(t):
    return settings.segments(t("documents"), "doc_id", "text", settings.profile("prosa", titles={"least_score": 2.5}))


@query("SRC-38 SRC-40 SRC-41", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def stored_documents(t):
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("STR-11", "SELECT doc_id, regexp_matches(lang, '^[A-Za-z-]{2,5}$') AS valid FROM documents")
def language_override(t):
    return t("documents").select("doc_id", T.valid_language(F.col("lang")).alias("valid"))


@query("STR-12")
def language_vote(t):
    return t("documents").select("doc_id", T.language_vote(F.col("text")).alias("lang"))


@query("STR-19", "SELECT item_id, '<p>' || replace(text, chr(10), '<br>') || '</p>' AS html FROM benchmark")
def html_paragraphs(t):
    return t("benchmark").select("item_id", T.paragraphs_html(F.col("text")).alias("html"))


@query("CLN-01 CLN-14 SNK-06 CLN-16", r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g') AS cleaned FROM documents")
def clean_control_chars(t):
    return t("documents").select("doc_id", clean.control_chars(F.col("text")).alias("cleaned"))


_UNICODE = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\u[0-9a-fA-F]{4}', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', ' ', 'g'), "
    r"'[\x{FEFF}\x{200B}-\x{200F}\x{2028}\x{2029}]', ' ', 'g'), '\\[uU][0-9a-fA-F]{0,3}', ' ', 'g')"
)


@query(
    "CLN-02",
    rf"""WITH a AS (SELECT doc_id, {_UNICODE} AS t FROM documents),
    b AS (SELECT doc_id, t, length(regexp_replace(t, '[ \n]', '', 'g')) AS solid, len(regexp_extract_all(t, '[{clean.LETTER}]')) AS letters, len(regexp_extract_all(t, '[{clean.LETTER}]{{3,}}')) AS real_words FROM a)
    SELECT doc_id, CASE WHEN solid > 50 AND letters / nullif(solid, 0) < 0.3 AND real_words < 2 THEN '{clean.CORRUPT}' ELSE
    {STRIP % rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{WSQ}[+*/&%#$@!-]{{{{1,2}}}}{WSQ}', ' ', 'g'), '{WSQ}[a-zA-Z]{WSQ}', ' ', 'g'), '{WSQ}[0-9]{{{{1,2}}}}{WSQ}', ' ', 'g'), '{WSQ}+', ' ', 'g')".replace("{{", "{").replace("}}", "}")} END AS cleaned FROM b""" .replace("%%", "%"),
)
def clean_unicode(t):
    return t("documents").select("doc_id", clean.unicode_noise(F.col("text")).alias("cleaned"))


@query("CLN-03", f"SELECT doc_id, pos, length(line) < 15 OR regexp_matches(line, '^[0-9]+[.-]*[0-9]*$') OR (NOT regexp_matches(line, '{WSQ}') AND length(line) > 50) AS insignificant FROM ({LINES})")
def insignificant_blocks(t):
    return _lines(t).select("doc_id", "pos", clean.insignificant(F.col("line")).alias("insignificant"))


@query("MTH-05 SRC-27")
def corruption_ratio(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.round(clean.repeat_share(c), 6).alias("ratio"), clean.doubled(c).alias("doubled"))


@query("SRC-28")
def undoubled_lines(t):
    return _lines(t).where("length(line) > 0").select("doc_id", "pos", clean.undouble(F.col("line")).alias("line"))


@query("CLN-17 CLN-18")
def poem_cleaning(t):
    return t("documents").select("doc_id", clean.poem_text(F.col("text"), ("Antología",)).alias("cleaned"))


@query("AGG-11 AGG-12 CLN-04")
def header_footer_lines(t):
    b = _lines(t).select((F.col("doc_id") % 20).alias("book"), F.col("doc_id").alias("page"), "line")
    return clean.page_share(b, "book", "page", "line").select("book", "norm", "pages", "total")


@query("CLN-05 AUT-31")
def without_running_heads(t):
    b = _lines(t).select((F.col("doc_id") % 20).alias("book"), F.col("doc_id").alias("page"), "line")
    return clean.without_heads(b, clean.running_heads(b, "book", "page", "line", 0.05), "book", "line")


@query("CLN-07 CLN-08 CLN-09 CLN-10 CLN-11 CLN-12 WIN-02 STR-13")
def merged_lines(t):
    broken = F.regexp_replace("text", " (de|que|en|y|a|the|of) ", " $1\n")
    return t("documents").select("doc_id", F.posexplode(clean.merge_lines(F.split(broken, "\n"))).alias("pos", "paragraph"))


@query("CLN-13", f"SELECT doc_id, pos, length(line) <= 100 AND regexp_matches(line, '^\\p{{Lu}}') AND len(regexp_extract_all(line, '[^ \\t\\n\\r\\f\\v]+')) <= 5 AND len(list_filter(regexp_extract_all(line, '[^ \\t\\n\\r\\f\\v]+'), lambda w: regexp_matches(w, '^\\p{{Lu}}'))) > 0.6 * len(regexp_extract_all(line, '[^ \\t\\n\\r\\f\\v]+')) AS title FROM ({LINES})")
def title_shapes(t):
    return _lines(t).select("doc_id", "pos", clean.looks_like_title(F.col("line")).alias("title"))


@query("CLN-19 WIN-01")
def prepared_blocks(t):
    return clean.prepared(_lines(t), "doc_id", "pos", "line").select("doc_id", "order", "line")


_STATS = f"""WITH l AS (SELECT doc_id, pos, {STRIP % 'line'} AS line FROM ({LINES}) WHERE pos < 100),
f AS (SELECT *, line <> '' AND length(line) <= 180 AS s, lag(line <> '' AND length(line) <= 180) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM l),
g AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (line <> '') AS full_lines, count(*) FILTER (line <> '' AND length(line) <= 180) AS n_short,
count(*) FILTER (line <> '' AND length(line) <= 100) AS n_very, count(*) FILTER (s AND NOT coalesce(p, false)) AS groups, coalesce(avg(length(line)) FILTER (line <> ''), 0) AS avg_length FROM f GROUP BY doc_id)"""


@query("PRO-02 AGG-09 WIN-04 PRO-05", f"{_STATS} SELECT doc_id, lines, full_lines, round(coalesce(n_short / nullif(full_lines, 0), 0), 6) AS short, round(coalesce(n_very / nullif(full_lines, 0), 0), 6) AS very_short, round((lines - full_lines) / lines, 6) AS blank, groups, round(avg_length, 4) AS avg_length FROM g")
def structure_stats(t):
    s = profile.line_stats(t("documents"), "text")
    r = lambda c, n=6: F.round(f"stats.{c}", n).alias(c)
    return s.select("doc_id", F.col("stats.lines").cast("long").alias("lines"), F.col("stats.full").cast("long").alias("full_lines"), r("short"), r("very_short"), r("blank"), F.col("stats.groups").cast("long").alias("groups"), r("avg_length", 4))


_PROFILE = f"""{_STATS}, x AS (SELECT *, coalesce(n_short / nullif(full_lines, 0), 0) AS sh, coalesce(n_very / nullif(full_lines, 0), 0) AS vs, (lines - full_lines) / lines AS bl FROM g),
y AS (SELECT *, (sh >= 0.8)::INT + (vs >= 0.6)::INT + (bl > 0.005)::INT + (groups >= 2)::INT AS met, round(0.4 * (sh >= 0.8)::INT + 0.3 * (vs >= 0.6)::INT + 0.2 * (bl > 0.005)::INT + 0.1 * (groups >= 2)::INT, 6)::DOUBLE AS score,
(sh >= 0.8)::INT + (vs >= 0.7)::INT + (avg_length <= 150)::INT AS strong FROM x)
SELECT doc_id, CASE WHEN full_lines < 5 THEN 'prosa' WHEN score >= 0.8 AND met >= 2 OR strong >= 2 THEN 'verso' ELSE 'prosa' END AS profile,
CAST(CASE WHEN full_lines < 5 THEN 0.4 WHEN score >= 0.8 AND met >= 2 THEN score WHEN strong >= 2 THEN least(0.85, round(0.6 + 0.1 * strong, 6)) ELSE 0.7 END AS DOUBLE) AS confidence FROM y"""


@query("PRO-03 PRO-01 PRO-06", _PROFILE)
def profile_detect(t):
    return profile.classify(profile.line_stats(t("documents"), "text")).select("doc_id", "profile", "confidence")


@query("PRO-04 FLT-20", f"SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '([^/]*)$', 1)), '{profile.VERSE_NAMES}') THEN 'verso' WHEN regexp_matches(lower(regexp_extract(url, '([^/]*)$', 1)), '{profile.PROSE_NAMES}') THEN 'prosa' END AS hint FROM pages")
def profile_filename(t):
    return t("pages").select("page_id", profile.name_hint(F.col("url")).alias("hint"))


@query("PRO-09", f"WITH l AS (SELECT doc_id, {STRIP % 'line'} AS line FROM ({LINES})), a AS (SELECT doc_id, count(*) FILTER (line <> '') AS n, count(*) FILTER (regexp_matches(line, '^[0-9]+[.: ]')) AS k, avg(length(line)) FILTER (line <> '') AS av FROM l GROUP BY doc_id) SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN k > 0.3 * n THEN 'biblical_text' WHEN av < 60 THEN 'poetry' WHEN av > 120 THEN 'continuous_prose' ELSE 'mixed_content' END AS content_type FROM a")
def content_type(t):
    return profile.content_type(t("documents"), "text").select("doc_id", "content_type")


@query("PRO-10", "SELECT pattern, CAST(sum(k) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) AS k FROM ({LINES}) WHERE regexp_matches(line, '{p}')" for k, p in profile.NUMBERING.items()) + ") GROUP BY pattern HAVING sum(k) > 0")
def numbering_patterns(t):
    return profile.numbering(_lines(t), "line")


@query("PRO-11")
def line_samples(t):
    return t("documents").select("doc_id", F.array_join(profile.samples(F.col("text")), "\n").alias("sample"))


@query("SEG-30 SEG-31", f"SELECT doc_id, CAST(0 AS INTEGER) AS pos, {STRIP % 'text'} AS chunk FROM documents")
def whole_chunks(t):
    return segment.whole(t("documents"), "doc_id", "text")


@query("SEG-01", rf"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+([A-ZÁÉÍÓÚÜÑ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')) AS sentences FROM documents")
def sentence_split(t):
    return t("documents").select("doc_id", F.size(segment.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("SEG-01 SEG-02 WIN-12")
def sentence_pack_300(t):
    return segment.prose(t("documents"), "doc_id", "text")


@query("SEG-03")
def fused_paragraphs(t):
    return t("documents").select("doc_id", F.posexplode(segment.fused(F.col("text"))).alias("pos", "paragraph"))


@query("SEG-07 SEG-25 SEG-11")
def subdivided_blocks(t):
    return t("documents").select("doc_id", F.posexplode(segment.subdivide(F.col("text"))).alias("pos", "piece")).withColumn("small", segment.too_small(F.col("piece")))


@query("SEG-06 SEG-13 WIN-10")
def title_score(t):
    scored = _lines(t).withColumn("score", segment.title_score(F.col("line"))).where("score >= 2.5")
    return segment.score_levels(scored, "doc_id", "score").select("doc_id", "pos", "score", "level")


@query("AGG-13 MTH-06", f"SELECT doc_id, pos, round(avg(length(line)) OVER (PARTITION BY doc_id), 4) AS avg_length, round(stddev_pop(pos) OVER (PARTITION BY doc_id), 4) AS std_font FROM ({LINES})")
def layout_baseline(t):
    b = segment.layout_baseline(_lines(t), "doc_id", "pos", "line")
    return b.select("doc_id", "pos", F.round("avg_length", 4).alias("avg_length"), F.round("std_font", 4).alias("std_font"))


@query("SEG-08 SEG-09 SEG-10 STR-14 SRC-16")
def heading_flags(t):
    c = F.col("line")
    return _lines(t).select("doc_id", "pos", segment.is_heading(c).alias("heading"), segment.heading_level(c).alias("level"), segment.heading_title(c).alias("title"))


@query("SEG-04")
def heading_segments(t):
    return segment.heading_segments(t("documents"), "doc_id", "text")


@query("SEG-05 SEG-12 WIN-07")
def section_tree(t):
    h = _lines(t).where(F.col("line") != "").withColumn("level", segment.heading_level(F.col("line")))
    return segment.section_tree(h, "doc_id", "pos", "level").select("doc_id", "pos", "level", "parent")


@query("SEG-23 SEG-24 SEG-26 SEG-27 WIN-03")
def markdown_merge(t):
    return segment.merged_blocks(_lines(t), "doc_id", "pos", "line")


@query("SEG-16 SEG-17 SEG-18 SEG-21", f"SELECT doc_id, count(*) FILTER ({STRIP % 'line'} <> '' AND length({STRIP % 'line'}) <= 120) AS verses FROM ({LINES}) GROUP BY doc_id")
def verse_counts(t):
    return _lines(t).groupBy("doc_id").agg(F.count_if(segment.is_verse(F.col("line"))).alias("verses"))


@query("SEG-16 SEG-18 SRC-31")
def verse_titles(t):
    c = F.col("line")
    return _lines(t).select("doc_id", "pos", segment.title_block(c).alias("title"), segment.poem_title(c).alias("poem_title"))


@query("SEG-15")
def verse_presplit(t):
    return segment.presplit(t("documents"), "doc_id", "text")


@query("SEG-14 SEG-19 SEG-20 WIN-05 WIN-06")
def poem_segments(t):
    return segment.poems(_lines(t), "doc_id", "pos", "line")


@query("SEG-22 UDF-02 UDF-07")
def verse_or_prose(t):
    return segment.SEGMENTERS["verse"](t("documents"), "doc_id", "text")


@query("AGG-14")
def poem_stats(t):
    p = segment.poems(_lines(t), "doc_id", "pos", "line")
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("poems"), F.sum("verses").alias("verses"), F.sum(F.length("segment")).alias("chars"))


@query("SEG-28")
def markdown_poems(t):
    b = t("conversations").withColumn("kind", F.when(F.col("role") == "user", "title").otherwise("verse"))
    return segment.typed_runs(b, "conv_id", "turn", "kind", "text")


@query("SNK-01 SNK-03", "SELECT text, 'turn' AS type, nullif(turn, 0) AS order_no FROM conversations")
def generic_records(t):
    g = sinks.generic(t("conversations").withColumn("kind", F.lit("turn")), "text", "kind", "turn")
    return g.select("text", "type", F.col("order").alias("order_no"))


@query("SNK-04 MAP-01 MAP-03")
def metadata_maps(t):
    m = F.create_map(F.lit("title"), F.col("source"), F.lit("pages"), F.col("n_chars").cast("string"), F.lit("gone"), F.lit(None).cast("string"))
    d = t("documents").select("doc_id", sinks.kept_metadata(m).alias("kept"), sinks.prefixed(m, ("title",)).alias("extra"))
    return d.select("doc_id", F.to_json("kept").alias("kept"), F.to_json("extra").alias("extra"))


@query("SNK-09 SNK-10", "SELECT conv_id, count(*) AS total_segments, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS full_content FROM conversations GROUP BY conv_id")
def conversation_threads(t):
    return sinks.whole_documents(t("conversations"), "conv_id", "turn", "text").select("conv_id", "total_segments", "full_content")


@query("SNK-11 SNK-12 FLT-19", "SELECT c.conv_id, c.turn, c.text, d.source FROM conversations c JOIN documents d ON c.conv_id = d.doc_id")
def index_documents(t):
    docs = t("documents").select(F.col("doc_id").alias("conv_id"), "source")
    return sinks.index_documents(t("conversations").select("conv_id", "turn", "text"), docs, "conv_id", ("source",))


@query("SET-01 SRC-32", "SELECT doc_id AS id, text, 'documents' AS _source_file, 2 AS _file_index FROM documents UNION ALL SELECT conv_id, text, 'conversations', 1 FROM conversations")
def unify_sources(t):
    return sinks.unified(documents=t("documents").select(F.col("doc_id").alias("id"), "text"), conversations=t("conversations").select(F.col("conv_id").alias("id"), "text"))


@query("SET-02 SRT-13", "SELECT event_type, count(*) AS entries FROM events GROUP BY event_type")
def valid_files(t):
    return sinks.valid_files(t("events"), "event_type", "props")


# ---- authors


def _attributed(t):
    who = F.when(F.col("doc_id") % 3 == 0, "Ana López Ruiz").when(F.col("doc_id") % 3 == 1, "Pedro Gómez").otherwise("Marta Díaz")
    return t("documents").select("doc_id", "source", F.concat(F.lit("Escrito por "), who, F.lit(".\n"), F.regexp_replace("text", r"[-–—]", " ")).alias("text"))


@query("AUT-17", "SELECT event_id, CASE WHEN value % 1 < 0.1 THEN 0.8 WHEN value % 1 < 0.2 THEN 0.6 WHEN value % 1 > 0.9 THEN 0.7 WHEN value % 1 > 0.8 THEN 0.5 ELSE 0.2 END::DOUBLE AS score FROM events")
def author_position_score(t):
    return t("events").select("event_id", authors.positional(F.col("value") % 1).cast("double").alias("score"))


@query("AUT-33", "SELECT doc_id, 'idiot' AS author, len(regexp_extract_all(lower(text), '\\bidiot\\b')) AS n FROM documents WHERE regexp_matches(lower(text), '\\bidiot\\b')")
def author_mentions(t):
    return authors.mentions(t("documents"), "doc_id", "text", ["idiot"]).select("doc_id", "author", F.col("n").cast("long").alias("n"))


@query("AGG-15 SET-14 SET-16", "SELECT c_nationkey, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS folded, count(*) AS n FROM customer GROUP BY 1, 2")
def author_merge(t):
    return authors.merge_candidates(t("customer"), "c_nationkey", "c_mktsegment").select("c_nationkey", "folded", "n")


@query("AGG-16 ARR-01 ARR-02 ARR-03")
def style_features(t):
    return authors.style(t("documents"), "doc_id", "text")


@query("AUT-10 AUT-11", "SELECT event_id, round(0.4 * least(user_id % 4 / 3.0, 1) + CASE WHEN value % 1 < 0.2 THEN 0.3 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM events")
def author_fallback_score(t):
    s = authors.fallback_score(F.col("user_id") % 4, F.col("value") % 1, F.col("user_id") % 2 == 0, F.lit(False))
    return t("events").select("event_id", F.round(s, 6).alias("score"))


# ---- search

_HIT = r"regexp_matches(text, '(?i)\b%s\b')"


@query("SEA-01 SEA-02 SEA-04 SEA-06 FLT-18 JOI-10", r"SELECT doc_id, length(regexp_extract(text, '(?is)^(.*?)\b(?:thing|heath)\b', 1)) AS position, regexp_extract(text, '(?is)\b(thing|heath)\b', 1) AS match FROM documents WHERE regexp_matches(text, '(?i)\b(thing|heath)\b')")
def search_literal_or(t):
    return search.literal(t("documents"), "text", "thing OR heath", True).select("doc_id", F.col("position").cast("long").alias("position"), "match")


@query("SEA-03", f"SELECT doc_id FROM documents WHERE {_HIT % 'the'} AND {_HIT % 'that'}")
def search_literal_and(t):
    return search.literal(t("documents"), "text", "the AND that", True).select("doc_id")


@query("SEA-03 SEA-05", f"SELECT doc_id FROM documents WHERE NOT {_HIT % 'the'}")
def search_literal_not(t):
    return search.literal(t("documents"), "text", "NOT the", True).select("doc_id")


@query("SEA-04", f"SELECT doc_id FROM documents WHERE {_HIT % 'of the'}")
def search_literal_phrase(t):
    return search.literal(t("documents"), "text", '"of the"', True).select("doc_id")


@query("SEA-06 STR-18", r"SELECT doc_id, regexp_replace(CASE WHEN p > 180 THEN '...' ELSE '' END || replace(substr(text, greatest(p - 180, 0) + 1, least(p + length(m) + 180, length(text)) - greatest(p - 180, 0)), chr(10), ' ') || CASE WHEN p + length(m) + 180 < length(text) THEN '...' ELSE '' END, '(?i)\b(thing)\b', '<mark>\1</mark>', 'g') AS marked FROM (SELECT doc_id, text, length(regexp_extract(text, '(?is)^(.*?)\bthing\b', 1)) AS p, 'thing' AS m FROM documents WHERE regexp_matches(text, '(?i)\bthing\b'))")
def search_context(t):
    return search.literal(t("documents"), "text", "thing", True).select("doc_id", "marked")


@query("SEA-10", "SELECT doc_id, count(*) AS n, min(p) AS first FROM (SELECT doc_id, unnest(list_filter(range(0, length(text)), lambda i: lower(substr(text, i + 1, 5)) = 'thing')) AS p FROM (SELECT doc_id, text FROM documents WHERE contains(lower(text), 'thing'))) GROUP BY doc_id")
def search_in_document(t):
    o = search.occurrences(t("documents"), "doc_id", "text", "thing")
    return o.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("position").cast("long").alias("first"))


_TOKENS = f"SELECT doc_id, unnest(list_filter(string_split_regex(lower(translate(text, '{T.ACCENTED}', '{T.FOLDED}')), '[^a-z0-9ß]+'), lambda w: w <> '')) AS term FROM documents"


@query("SEA-11", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM ({_TOKENS}) GROUP BY term")
def inverted_index(t):
    return search.inverted_index(t("documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("SEA-11")
def search_ranked(t):
    return search.ranked(search.inverted_index(t("documents"), "doc_id", "text"), "doc_id", ["thing", "heath"], 1)


_Q = [round(0.01 * i - 0.3, 2) for i in range(64)]


@query("SEA-07 MTH-01 SRT-03 JOI-11 EMB-06 FLT-10", f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_Q}::DOUBLE[], {_Q}::DOUBLE[]))), 4) AS similarity FROM embeddings ORDER BY list_dot_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) DESC, vec_id LIMIT 10")
def semantic_topk(t):
    return search.nearest(t("embeddings"), "vec_id", "embedding", _Q).select("vec_id", F.round("similarity", 4).alias("similarity"))


@query("JOI-01 JOI-02", "SELECT e.vec_id, d.source, l.quality FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id JOIN labels l ON e.vec_id = l.doc_id")
def semantic_join(t):
    e = t("embeddings").select("vec_id", F.col("vec_id").alias("doc_id"))
    return search.joined_segments(e, t("documents").select("doc_id", "source"), t("labels").select("doc_id", "quality"), "doc_id", "doc_id").select("vec_id", "source", "quality")


@query("EMB-01 EMB-03 SEA-07")
def semantic_batch(t):
    e = t("embeddings")
    return search.nearest_to_each(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).withColumn("similarity", F.round("similarity", 4))


# ---- rules, JSON, HTML


@query("FLT-02 FLT-03 FLT-04 FLT-06 UDF-05", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events WHERE CAST(props->>'k' AS INTEGER) >= 3 AND CAST(props->>'k' AS INTEGER) <> 5")
def rule_filter_events(t):
    e = t("events").withColumn("doc", rules.parsed(F.col("props")))
    wanted = [rules.adapt({"field": "k", "operator": "gte", "value": 3}), rules.adapt({"field": "k", "value": 5, "negate": True})]
    return e.where(rules.compiled(F.col("doc"), wanted)).select("event_id", rules.at(F.col("doc"), "k", "int").alias("k"))


@query("FLT-01 JSN-01", "SELECT event_id, props->>'k' AS k, NULL::VARCHAR AS missing FROM events")
def json_paths(t):
    d = t("events").withColumn("doc", rules.parsed(F.col("props")))
    return d.select("event_id", rules.at(F.col("doc"), "k").alias("k"), rules.at(F.col("doc"), "a.b[0].c").alias("missing"))


@query("FLT-04 FLT-05 SRC-05 SRC-06 SRC-07", "SELECT doc_id, trim(text, E' \\t\\n\\r\\f\\v') AS text, source AS pointer FROM documents WHERE length(trim(text, E' \\t\\n\\r\\f\\v')) >= 100")
def json_extract(t):
    raw = F.to_json(F.struct(F.array(F.struct("text", "source")).alias("items"), F.lit(1).alias("v")))
    d = t("documents").select("doc_id", F.replace(raw, F.lit("\x7f"), F.lit("\\u007f")).alias("raw"))  # bare it would become a blank
    found = rules.items(d.withColumn("doc", rules.parsed(F.col("raw"))), "doc")
    return rules.extract(found, "item", [rules.Rule("text", "exists")], ["missing", "text"], "source", None, 100).select("doc_id", "text", "pointer")


@query("JSN-02 JSN-03 SRC-04", "SELECT doc_id, text, source AS author FROM documents WHERE text <> ''")
def ndjson_records(t):
    d = t("documents").select("doc_id", rules.parsed(F.to_json(F.struct(F.col("text").alias("content"), F.col("source").alias("autor")))).alias("doc"))
    return rules.records(d, "doc").select("doc_id", "text", "author").where("text IS NOT NULL")


@query("SRC-34", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\r\f\v]+', ' ', 'g')) AS title FROM pages")
def html_title(t):
    return t("pages").select("page_id", files.html_title(F.col("html")).alias("title"))


@query("SRC-33")
def html_text(t):
    return t("pages").select("page_id", files.html_text(F.col("html")).alias("text"))


@query("SRC-39", "SELECT page_id, regexp_extract(url, '([^/]+)/[^/]*$', 1) AS folder FROM pages")
def source_folders(t):
    return t("pages").select("page_id", files.source_folder(F.col("url")).alias("folder"))


@query("SRC-21 SRC-22 SRC-23")
def ocr_blocks(t):
    return files.ocr_blocks(_lines(t), "doc_id", "pos", "line")


@query("SRC-26")
def typed_markdown(t):
    return files.typed_markdown(t("documents").select(F.col("doc_id").alias("path"), "text"))


@query("SRC-29 SRC-30")
def poetry_shapes(t):
    c = F.col("text")
    return t("documents").select("doc_id", files.looks_like_poetry(c).alias("poetry"), F.regexp_count(files.verse_lines(c), F.lit("\n")).alias("breaks"))


@query("SRC-24")
def first_answers(t):
    return t("documents").select("doc_id", files.first_answer(F.lit(" "), F.col("lang")).alias("answer"))


# ---- reader


@query("RDR-01 RDR-03 WIN-08 JOI-07 JOI-08")
def app_pages(t):
    paged = reader.pages(_lines(t), "doc_id", "pos", "line")
    return reader.page_ranges(paged, "doc_id", "pos", T.word_count(F.col("line")))


@query("RDR-02")
def toc(t):
    b = _lines(t).withColumn("kind", F.when(segment.is_heading(F.col("line")), F.concat(F.lit("title_level_"), segment.heading_level(F.col("line")))).otherwise("paragraph"))
    return reader.contents(reader.pages(b, "doc_id", "pos", "line", "kind"), "doc_id", "pos", "kind", "line")


@query("WIN-09", "SELECT conv_id, turn, round(row_number() OVER (PARTITION BY conv_id ORDER BY turn) * 100.0 / count(*) OVER (PARTITION BY conv_id), 4)::DOUBLE AS progress FROM conversations")
def reading_progress(t):
    return reader.progress(t("conversations"), "conv_id", "turn").select("conv_id", "turn", F.col("progress").cast("double").alias("progress"))


@query("JOI-06", "SELECT d.doc_id, coalesce(c.n, 0) AS n_notes FROM documents d LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c ON c.conv_id = d.doc_id")
def segment_notes(t):
    n = t("conversations").withColumnRenamed("conv_id", "doc_id").select("doc_id", "turn", "text")
    return reader.with_notes(t("documents").select("doc_id"), n, "doc_id", "turn").select("doc_id", F.col("n_notes").cast("long").alias("n_notes"))


@query("RDR-05 WIN-13", "SELECT item_id, left(text, 5) || '<mark>' || substr(text, 6, 4) || '</mark>' || substr(text, 10) AS marked FROM benchmark")
def annotate_text(t):
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(4).alias("size")))
    return t("benchmark").select("item_id", reader.annotate(F.col("text"), spans).alias("marked"))


# ---- time


@query("STM extension", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t):
    return incremental.tumbling(t("events"), "ts", "1 hour", "event_type", value="value").withColumn("total", F.round("total", 4))


@query("STM extension", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(t):
    return incremental.sessions(t("events"), "user_id", "ts", "30 minutes")


@query("STM-01 EMB-04", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100")
def incremental_todo(t):
    return incremental.unprocessed(t("documents").select("doc_id"), t("labels"), "doc_id", 100)


# ---- queries over inputs that reach all of an operator's cases


@query("STR-05 STR-06 STR-07", f"SELECT p_partkey, {restated.clean_name(restated.PERSON)} AS name FROM part")
def clean_person_names(t):
    raw = F.concat(F.lit('  "'), F.upper("p_name"), F.lit("  DE  la "), F.lower("p_type"), F.lit(' y PEÑA-8", '))
    return t("part").select("p_partkey", T.clean_name(raw).alias("name"))


@query("SRC-38 SRC-40", "SELECT table_name AS name, row_number() OVER (ORDER BY table_name) AS position FROM information_schema.tables")
def stored_tables(t):
    names = t.listing().select(F.regexp_extract("path", r"/([^/]+)\.parquet(?:/.*)?$", 1).alias("name")).where("name <> ''").distinct()
    return names.select("name", F.row_number().over(Window.orderBy("name")).cast("long").alias("position"))


@query("SRC-40", "WITH p AS (SELECT regexp_extract(url, '://(.*)$', 1) AS path FROM pages), i AS (SELECT path FROM p WHERE path <> ''), n AS (SELECT regexp_extract(path, '^([^/]*)', 1) AS name, bool_or(contains(path, '/')) AS is_dir, count(*) AS files FROM i GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY is_dir DESC, name) AS INTEGER) AS position FROM n")
def folder_listing(t):
    return files.folder(t("pages").select(F.regexp_extract("url", "://(.*)$", 1).alias("path")), "path")


@query("STR-08", "SELECT doc_id, CASE WHEN a > 50 THEN '...' ELSE '' END || replace(substr(text, greatest(a - 50, 0) + 1, greatest(least(a + 60, length(text)) - greatest(a - 50, 0), 0)), chr(10), ' ') || CASE WHEN least(a + 60, length(text)) < length(text) THEN '...' ELSE '' END AS context FROM (SELECT doc_id, text, CAST(doc_id * 7 % 400 AS INTEGER) AS a FROM documents)")
def text_context(t):
    return t("documents").select("doc_id", T.context(F.col("text"), (F.col("doc_id") * 7 % 400).cast("int"), F.lit(10)).alias("context"))


@query("DAT-01", "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN strftime(o_orderdate, '%Y') WHEN 6 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def publication_dates(t):
    shapes = ["dd/MM/yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "yyyyMMdd", "yyyy", "'2024-13-'dd"]
    raw = reduce(lambda c, k: c.when(F.col("o_orderkey") % 7 == k, F.concat(F.lit(" "), F.date_format("o_orderdate", shapes[k]))), range(1, 7), F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", shapes[0])))
    return t("orders").select("o_orderkey", T.publication_date(raw).alias("d"))


@query(
    "DAT-02 DAT-03 DAT-04 DAT-05",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN strftime(o_orderdate, '%Y')"
    " WHEN 3 THEN strftime(o_orderdate, '%Y') WHEN 4 THEN strftime(o_orderdate, '%Y-%m') END AS p FROM orders",
)
def filename_dates(t):
    shapes = ["'nota 'yyyy-MM-dd'.md'", "'acta_'yyyyMMdd'_v.csv'", "'x-'dd_MM_yyyy'.xlsx'", "'y_'yyyy_MM_dd'.docx'", "'mes 'yyyy-MM'.md'", "'sin fecha.txt'"]
    name = reduce(lambda c, k: c.when(F.col("o_orderkey") % 6 == k, F.date_format("o_orderdate", shapes[k])), range(1, 6), F.when(F.col("o_orderkey") % 6 == 0, F.date_format("o_orderdate", shapes[0])))
    return t("orders").select("o_orderkey", T.filename_date(name).alias("d"), T.partial_date(name).alias("p"))


_BAD = "text || repeat(chr(65533), CAST(doc_id % 70 AS INTEGER))"


@query(
    "CLN-15 SNK-05",
    f"WITH b AS (SELECT doc_id, {_BAD} AS raw, {STRIP % _BAD} AS t, CAST(doc_id % 70 AS INTEGER) AS bad FROM documents), c AS (SELECT *, length(t) >= 10 AND (bad >= 10 OR regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]{{5,}}')) AS corrupt FROM b)"
    f" SELECT doc_id, corrupt, CASE WHEN corrupt THEN '{sinks.UNREADABLE}' ELSE regexp_replace(raw, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g') END AS written FROM c",
)
def extreme_corruption(t):
    raw = F.concat("text", F.repeat(F.lit("�"), (F.col("doc_id") % 70).cast("int")))
    return t("documents").select("doc_id", clean.extremely_corrupt(raw).alias("corrupt"), sinks.safe_text(raw).alias("written"))


@query("CLN-06 AGG-10", f"SELECT doc_id, n, round(short, 6) AS short, round(single, 6) AS single, round(open_end, 6) AS open_end, round(avg_len, 4) AS avg_len, (n >= 50 AND short > 0.65 AND single > 0.75 AND open_end > 0.7) OR (n > 500 AND avg_len < 120 AND short > 0.5) AS fragmented FROM (SELECT doc_id, count(*) AS n, avg((length(line) < 100)::INT) AS short, 1.0::DOUBLE AS single, avg((NOT regexp_matches({STRIP % 'line'}, '[.!?:;]$'))::INT) AS open_end, avg(length(line)) AS avg_len FROM (SELECT doc_id % 40 AS doc_id, regexp_replace(line, '[.]', '', 'g') AS line FROM ({LINES})) GROUP BY doc_id)")
def ocr_fragmentation(t):
    b = _lines(t).select((F.col("doc_id") % 40).alias("doc_id"), F.regexp_replace("line", "[.]", "").alias("line"))
    r = lambda c: F.round(c, 6).alias(c)
    return clean.fragmented(b, "doc_id", "line").select("doc_id", "n", r("short"), r("single"), r("open_end"), F.round("avg_len", 4).alias("avg_len"), "fragmented")


@query("SEG-29 SEG-33 SRC-01 SRC-02", f"WITH d AS (SELECT doc_id, {restated.blocks('replace(text, chr(10), chr(10) || chr(32) || chr(10))')} AS b FROM documents) SELECT doc_id, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS pos, unnest(b) AS chunk FROM d")
def paragraph_chunks(t):
    d = t("documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n")))
    return segment.STRATEGIES["paragraph"](d, "doc_id", "text")


_REFS = "replace('antes ' || text, chr(10), chr(10) || '{PVGM 1.' || (doc_id % 9) || '} ')"


@query("SEG-32", f"WITH d AS (SELECT doc_id, string_split(regexp_replace({_REFS}, '(\\{{\\s*[A-Z]{{2,5}}\\s+\\d{{1,3}}\\.\\d{{1,3}}\\s*\\}})', chr(1) || '\\1', 'g'), chr(1)) AS p FROM documents), c AS (SELECT doc_id, CASE WHEN len(p) = 1 THEN p ELSE p[2:] END AS p FROM d), u AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS chunk FROM c) SELECT doc_id, pos, chunk, nullif(regexp_extract(chunk, '^\\{{[^}}]*\\}}'), '') AS reference FROM u")
def reference_chunks(t):
    raw = F.replace(F.concat(F.lit("antes "), "text"), F.lit("\n"), F.concat(F.lit("\n{PVGM 1."), (F.col("doc_id") % 9).cast("string"), F.lit("} ")))
    return segment.by_reference(t("documents").select("doc_id", raw.alias("text")), "doc_id", "text")


_DOUBLED = "replace(text, chr(10), chr(10) || chr(10))"
_PARAGRAPHS = f"d AS (SELECT doc_id, source, {_DOUBLED} AS text FROM documents), p AS (SELECT *, list_filter(string_split(text, chr(10) || chr(10)), lambda x: {STRIP % 'x'} <> '') AS p FROM d), q AS (SELECT doc_id, source, text, CASE WHEN len(p) > 1 THEN 'paragraph' ELSE 'document' END AS kind, CASE WHEN len(p) > 1 THEN p ELSE [text] END AS p FROM p), s AS (SELECT doc_id, source, text, kind, CAST(generate_subscripts(p, 1) AS INTEGER) AS segment_order, unnest(p) AS segment FROM q)"


def _doubled(t):
    return t("documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query("SEG-34 JOI-04 SRT-07", f"WITH {_PARAGRAPHS} SELECT doc_id, segment_order, kind, segment FROM s")
def library_segments(t):
    return segment.library_segments(_doubled(t), "doc_id", "text")


@query("SEG-35", f"WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '\\n([^\\n]*)\\n', chr(10) || '# \\1' || chr(10), 'g'), '(?m)^#[ \\t]+', chr(1), 'g'), chr(1)), lambda x: {STRIP % 'x'} <> '') AS n FROM documents), u AS (SELECT doc_id, CAST(generate_subscripts(n, 1) - 1 AS INTEGER) AS pos, unnest(n) AS n FROM d) SELECT doc_id, pos, regexp_extract(n, '^([^\\n]*)', 1) AS title, {STRIP % restated.AFTER_FIRST_LINE} AS content FROM u")
def markdown_notes(t):
    d = t("documents").select("doc_id", F.regexp_replace("text", r"\n([^\n]*)\n", "\n# $1\n").alias("text"))
    return segment.notes(d, "doc_id", "text")


@query("SEG-36 SNK-02 AUT-35", f"WITH {_PARAGRAPHS}, v AS ({restated.language_vote(_DOUBLED)}) SELECT sha256(sha256(text) || '-' || segment_order) AS segment_id, sha256(text) AS document_id, segment AS text, kind AS segment_type, segment_order, length(segment) AS text_length, source AS source_file_path, coalesce(nullif(v.lang, 'und'), 'unknown') AS document_language, 'src ' || source AS author FROM s JOIN v USING (doc_id)")
def segments_enriched(t):
    d = _doubled(t)
    e = segment.enriched(segment.library_segments(d, "doc_id", "text"), d, "doc_id", "text", "source")
    names = d.select(F.col("source").alias("source_file_path"), F.concat(F.lit("src "), "source").alias("author")).distinct()
    return authors.attach(e, names, "source_file_path").select("segment_id", "document_id", "text", "segment_type", "segment_order", F.col("text_length").cast("long").alias("text_length"), "source_file_path", "document_language", "author")


@query("SNK-03 SNK-07 SNK-14", "SELECT conv_id, string_agg(turn || ' ' || role || ' ' || text, '|' ORDER BY turn) AS segments FROM conversations GROUP BY conv_id")
def grouped_json(t):
    g = sinks.grouped_json(t("conversations"), "conv_id", "turn")
    parsed = F.from_json("value", "conv_id long, segments array<struct<turn:long,role:string,text:string>>")
    return g.select(parsed.alias("_v")).select("_v.conv_id", F.array_join(F.transform("_v.segments", lambda x: F.concat_ws(" ", x["turn"], x["role"], x["text"])), "|").alias("segments"))


@query("SNK-08", "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(n, '\\.[^.]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed_file') || CASE WHEN contains(n, '.') THEN '_' || regexp_extract(n, '\\.([^.]*)$', 1) ELSE '' END || '.ndjson' AS name FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '([^/]*)$', 1) ELSE 'acta ' || page_id || '.tar.csv' END AS n FROM pages)")
def output_names(t):
    path = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/a/acta "), F.col("page_id").cast("string"), F.lit(".tar.csv")))
    return t("pages").select("page_id", sinks.output_name(path).alias("name"))


@query("SET-01", "SELECT file_index, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS line_number FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY source) AS INTEGER) AS file_index FROM documents)")
def numbered_lines(t):
    return sinks.numbered(t("documents").select("source", "doc_id"), "source", "doc_id").select("file_index", "doc_id", "line_number")


@query("AUT-14 AUT-06 WIN-11", f"WITH {restated.ATTRIBUTED}, {restated.NAMES} SELECT doc_id, name, count(*) AS n FROM names GROUP BY doc_id, name")
def author_attribution_candidates(t):
    return authors.attributions(_attributed(t), "doc_id", "text")


@query("AUT-01 AUT-06 AUT-16 AUT-17 AUT-18 MTH-04 AUT-08", restated.ATTRIBUTION)
def author_attribution(t):
    return authors.attribute(_attributed(t), "doc_id", "text")


@query("AUT-15", restated.MORPHOLOGY)
def name_morphology(t):
    return t("part").select("p_partkey", F.round(authors.morphology(F.concat(F.lit("Don "), "p_name", F.when(F.col("p_partkey") % 2 == 0, " Martínez").otherwise(" de la Sol"))), 6).alias("score"))


@query("AUT-12 AUT-13 AUT-05 AUT-19 AUT-21", f"SELECT p_partkey, {restated.valid_name('n')} AS valid, regexp_matches(lower(n), '{authors.SOFTWARE}') AS software, regexp_matches(lower(n), '{authors.SECTIONS}') AS section FROM (SELECT p_partkey, {restated.CANDIDATE} AS n FROM part)")
def author_name_validity(t):
    k, name = F.col("p_partkey") % 6, F.initcap("p_name")
    n = F.when(k == 0, name).when(k == 1, F.col("p_name")).when(k == 2, F.concat(name, F.lit(" 9"))).when(k == 3, F.concat(name, F.lit(" Canta"))).when(k == 4, F.concat(name, F.lit(" Word Prólogo"))).otherwise(F.concat(name, F.lit(" De La Torre")))
    return t("part").select("p_partkey", authors.valid_name(n).alias("valid"), authors.is_software(n).alias("software"), authors.is_section(n).alias("section"))


@query("AUT-20 AUT-22 AUT-23 AUT-34 AUT-07", restated.FROM_TITLE)
def author_from_title(t):
    k, name = F.col("p_partkey") % 4, F.initcap("p_name")
    title = F.concat(F.lit("/libros/"), F.when(k == 0, F.concat(name, F.lit(" - Poemas"))).when(k == 1, F.concat(F.regexp_extract(name, r"(\S+)$", 1), F.lit(", "), F.regexp_extract(name, r"^(\S+)", 1))).when(k == 2, F.concat(F.translate(name, " ", "_"), F.lit("_Capítulo"))).otherwise(F.col("p_name")), F.lit(".pdf"))
    program = F.when(k < 2, F.lit("Adobe Acrobat")).otherwise(F.upper("p_name"))
    return t("part").select("p_partkey", F.array_join(authors.from_title(title), "|").alias("names"), authors.metadata_author(program, F.col("p_name")).alias("meta"))


@query("AUT-29 AUT-30 AUT-09 JOI-09 JOI-13 STR-21", restated.KNOWN)
def author_known(t):
    p = t("part")
    full = F.concat("p_name", F.lit(" "), F.lower("p_brand"))
    changed = F.when(F.col("p_partkey") % 3 == 0, F.upper(full)).when(F.col("p_partkey") % 3 == 1, F.concat(F.left(full, F.lit(2)), F.expr("substring(concat(p_name, ' ', lower(p_brand)), 4)"))).otherwise(F.concat(F.reverse("p_name"), F.lit(" z")))
    names = p.select("p_partkey", changed.alias("name"), F.lit(0.6).alias("confidence"))
    dictionary = p.where("p_partkey % 5 = 0").groupBy(full.alias("author")).agg(F.array(F.concat(F.reverse(F.first("p_name")), F.lit(" z"))).alias("aliases"))
    k = authors.known(names, "name", dictionary)
    return k.select("p_partkey", "canonical", F.round("match", 4).alias("match"), F.round(authors.boosted(F.col("confidence"), F.col("match")), 4).alias("confidence"))


@query("AUT-02 AUT-03 AUT-04 AGG-20 SRT-09", restated.CHOICE)
def author_choice(t):
    d, m = t("documents"), lambda k: (F.col("doc_id") % k).cast("int")
    one = lambda name, confidence, method: d.select("doc_id", name.alias("name"), confidence.alias("confidence"), F.lit(method).alias("method"))
    c = one(F.lit("Ana López"), m(10) / 10, "literary_db").unionByName(one(F.when(m(2) == 0, "ANA LOPEZ").otherwise("Juan Pérez"), m(7) / 7, "contextual")).unionByName(one(F.lit("Juan Pérez"), m(4) / 4, "stylistic")).unionByName(one(F.lit("Otro"), m(3) / 2, "unknown"))
    return authors.choose(c, "doc_id").select("doc_id", "author", "confidence", "method", F.col("agree").cast("int").alias("agree"))


@query("AUT-25", f"WITH s AS ({restated.SQL['author_literary']}), d AS (SELECT s.*, doc_id % 3 = 0 AS titled, doc_id % 3 = 1 AS filed FROM s), m AS (SELECT doc_id, author, CASE WHEN titled AND score > 0.3 THEN round(least(0.9, 0.7 + score), 6) WHEN filed AND score > 0.2 THEN round(least(0.85, 0.6 + score), 6) WHEN score > 0.5 THEN round(least(0.8, score), 6) END::DOUBLE AS confidence, CASE WHEN titled AND score > 0.3 THEN 'document_title' WHEN filed AND score > 0.2 THEN 'filename' ELSE 'text' END AS source FROM d) SELECT * FROM m WHERE confidence IS NOT NULL")
def author_literary_match(t):
    scored = authors.literary(t("documents"), "doc_id", "text", _literary_dictionary(t))
    title = F.when(F.col("doc_id") % 3 == 0, "Poemas de Ana Lopez").otherwise("Poemas")
    return authors.literary_match(scored, "doc_id", title, F.when(F.col("doc_id") % 3 == 1, "ana_lópez.txt").otherwise("x.txt"))


@query("AUT-24 AUT-26 AUT-27")
def author_literary(t):
    s = authors.literary(t("documents"), "doc_id", "text", _literary_dictionary(t))
    return s.select("doc_id", "author", F.round("score", 4).alias("score"), F.array_join("markers", "|").alias("markers"))


def _literary_dictionary(t):
    return t("region").limit(1).select(F.lit("Ana López").alias("author"), F.array(F.lit("the"), F.lit("and of")).alias("markers"), F.array(F.lit("cióníez")).alias("works"))


_LONG_WORDS = " Extraordinariamente, maravillosamente; incomprensiblemente! "


@query("AUT-28", f"SELECT doc_id, CASE WHEN word_length > 5.5 AND diversity > 0.6 AND punctuation > 0.05 AND doc_id % 2 = 0 THEN 0.7::DOUBLE END AS confidence FROM ({restated.style(f'left(text, 200) || {chr(39)}{_LONG_WORDS}{chr(39)}')})")
def author_modernism(t):
    text = F.concat(F.left("text", F.lit(200)), F.lit(_LONG_WORDS))
    f = authors.style(t("documents").select("doc_id", text.alias("text")), "doc_id", "text")
    return f.select("doc_id", authors.modernism(f, F.when(F.col("doc_id") % 2 == 0, "Antologia").otherwise("Otro")).alias("confidence"))


@query("EMB-02 MTH-02 SEA-08", f"SELECT vec_id, CAST(floor((1 - abs(similarity)) * 100 + 0.5) AS INTEGER) AS score, dims FROM (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_Q}::DOUBLE[], {_Q}::DOUBLE[]))), 6) AS similarity, 64 AS dims FROM embeddings)")
def semantic_scores(t):
    q = F.array(*[F.lit(x) for x in _Q])
    gone = F.when(F.col("vec_id") % 9 != 0, F.col("embedding"))
    return t("embeddings").select("vec_id", V.api_score(F.round(V.cosine(F.col("embedding"), q), 6)).alias("score"), F.size(V.or_zero(gone, 64)).alias("dims"))


@query("SEA-09 JOI-12 SET-15 SRT-10", f"WITH l AS (SELECT doc_id, 0.8::DOUBLE AS score, 'literal' AS origin FROM documents WHERE {_HIT % 'thing'}), s AS (SELECT vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_Q}::DOUBLE[], {_Q}::DOUBLE[]))), 6) AS score, 'semantic' AS origin FROM embeddings ORDER BY score DESC, doc_id LIMIT 40) SELECT doc_id, round(score, 4) AS score, origin FROM (SELECT * FROM l UNION ALL SELECT * FROM s WHERE doc_id NOT IN (SELECT doc_id FROM l)) ORDER BY score DESC, doc_id LIMIT 50")
def hybrid_search(t):
    lit = search.literal(t("documents"), "text", "thing", True).select("doc_id", "score")
    sem = search.nearest(t("embeddings"), "vec_id", "embedding", _Q, 40).select(F.col("vec_id").alias("doc_id"), F.round("similarity", 6).alias("score"))
    return search.hybrid(lit, sem, "doc_id", k=50).select("doc_id", F.round("score", 4).alias("score"), "origin")


@query("SRC-08", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'OBJECT<k: BIGINT>' WHEN 1 THEN 'ARRAY<BIGINT>' ELSE 'OBJECT<a: OBJECT<b: STRING>, c: BOOLEAN>' END AS json_schema, CAST(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN event_id % 5 + 1 ELSE 2 END AS INTEGER) AS entries FROM events")
def json_structure(t):
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, F.col("props")).when(k % 3 == 1, F.to_json(F.sequence(F.lit(0).cast("long"), k % 5))).otherwise(F.lit('{"a": {"b": "x"}, "c": true}'))
    return rules.structure(t("events").withColumn("doc", rules.parsed(raw)), "doc").select("event_id", "json_schema", "entries")


@query("JSN-04 JSN-05 SRC-03 DAT-06", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS title, CASE WHEN doc_id % 2 = 0 THEN '2024-01-0' || (doc_id % 9 + 1) END AS date, nullif(trim(regexp_extract('# ' || text, '(?m)^[ \\t]*#[ \\t]+(.+)$', 1), E' \\t\\r\\f\\v'), '') AS heading, length(text) + 2 AS body FROM documents")
def front_matter(t):
    title = F.coalesce(F.concat(F.lit("title: "), F.col("source"), F.lit("\n")), F.lit(""))
    head = F.concat(F.lit("---\n"), title, F.lit("date: 2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("\n---\n"))
    md = F.concat(F.when(F.col("doc_id") % 2 == 0, head).otherwise(""), F.lit("# "), F.coalesce("text", F.lit("")))
    head, body = files.front_matter(md)
    size = F.when(F.col("text").isNotNull(), F.length(body)).cast("long")
    return t("documents").select("doc_id", head["title"].alias("title"), head["date"].alias("date"), files.markdown_title(body).alias("heading"), size.alias("body"))


@query("SRC-09 SRC-10 SRC-14 SRC-37", "WITH r AS (SELECT s_nationkey AS path, 's_suppkey: ' || s_suppkey || '; s_name: ' || s_name || '; Columna_3: a,;|b' AS block, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier) SELECT path, CAST(pos AS INTEGER) AS pos, block FROM r")
def csv_blocks(t):
    sign = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("|")), (F.col("s_nationkey") % 4 + 1).cast("int"))
    row = F.concat_ws("\x01", F.col("s_suppkey"), "s_name", F.lit('"a,;|b"'), F.lit(""), F.lit(""), F.lit(""))
    f = t("supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    text = F.replace(F.concat(F.lit("s_suppkey\x01s_name\x01\x01Unnamed: 3\x01\x01\n"), "rows"), F.lit("\x01"), sign)
    return files.csv_blocks(f.select(F.col("s_nationkey").alias("path"), text.alias("text")))


@query("SRC-18 SRC-19", f"SELECT doc_id, count(*) <= 3 OR sum(len(regexp_extract_all(l, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}]'))) / greatest(sum(length(l)), 1) >= 0.7 AS ocr, doc_id % 8 <= 3 OR (doc_id % 50 >= 20 AND (doc_id % 8) / (doc_id % 50) < 0.1) AS ocr_after FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(line, '[a-z]', chr(1), 'g') ELSE line END AS l FROM ({LINES})) GROUP BY doc_id")
def ocr_decision(t):
    damaged = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("line", "[a-z]", "\x01")).otherwise(F.col("line"))
    d = files.needs_ocr(_lines(t).withColumn("line", damaged), "doc_id", "line")
    return d.select("doc_id", "ocr", files.needs_ocr_after(F.col("doc_id") % 8, F.col("doc_id") % 50).alias("ocr_after"))


@query("RDR-04 STR-20", f"SELECT doc_id, CAST(instr({restated.squeeze('text')}, {restated.squeeze('substr(text, 41, 30)')}) - 1 AS INTEGER) AS at FROM documents")
def highlight_place(t):
    selection = F.regexp_replace(F.substring("text", 41, 30), " ", "  \n")
    return t("documents").select("doc_id", reader.locate(F.col("text"), selection).alias("at"))


@query("PRO-07 PRO-08", f"{_STATS}, x AS (SELECT g.*, d.text, coalesce(n_short / nullif(full_lines, 0), 0) AS sh, coalesce(n_very / nullif(full_lines, 0), 0) AS vs, (lines - full_lines) / lines AS bl FROM g JOIN documents d USING (doc_id)), y AS (SELECT *, (sh >= 0.8)::INT + (vs >= 0.6)::INT + (bl > 0.005)::INT + (groups >= 2)::INT AS met, round(0.4 * (sh >= 0.8)::INT + 0.3 * (vs >= 0.6)::INT + 0.2 * (bl > 0.005)::INT + 0.1 * (groups >= 2)::INT, 6)::DOUBLE AS score, (sh >= 0.8)::INT + (vs >= 0.7)::INT + (avg_length <= 150)::INT + 1 AS strong FROM x), z AS (SELECT doc_id, CASE WHEN full_lines < 5 OR (score >= 0.8 AND met >= 2) OR strong >= 2 THEN 'verso' ELSE 'prosa' END AS profile, CASE WHEN {STRIP % 'text'} = '' THEN 0.5 WHEN full_lines < 5 THEN 0.4 WHEN score >= 0.8 AND met >= 2 THEN score WHEN strong >= 2 THEN least(0.85, round(0.6 + 0.1 * strong, 6)) ELSE 0.6 END AS confidence FROM y) SELECT doc_id, CASE WHEN confidence >= 0.5 THEN profile ELSE 'prosa' END AS profile FROM z")
def profile_auto(t):
    return profile.accepted(profile.detect(t("documents"), "text", F.concat(F.col("source"), F.lit("/poema.txt"))), 0.5).select("doc_id", "profile")


@query("PRO-10")
def numbering_details(t):
    r = profile.numbering_report(_lines(t), "doc_id", "pos", "line")
    return r.select("doc_id", "pattern", "n", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.array_join("examples", "|").alias("examples"))


@query("FLT-11 EMB-05", "SELECT vec_id FROM embeddings WHERE vec_id % 3 < 2 ORDER BY vec_id LIMIT 1000")
def missing_embeddings(t):
    e = t("embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 == 1, F.array().cast("array<float>")).when(F.col("vec_id") % 3 == 2, F.col("embedding")))
    return incremental.lacking(e, "embedding", "vec_id").select("vec_id")


@query("FLT-12", "SELECT doc_id FROM documents WHERE doc_id % 4 < 2 ORDER BY doc_id LIMIT 500")
def missing_index_flags(t):
    d = t("documents").withColumn("indexed", F.when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 > 1, "yes"))
    return incremental.lacking(d, "indexed", "doc_id", 500).select("doc_id")


@query("STM-04 STM-05", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS ts, CASE WHEN event_id % 3 = 0 THEN 'Desconocido' ELSE 'f' || event_id || '.json' END AS file, CASE event_id % 4 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'NameError' WHEN 2 THEN 'ValueError' ELSE 'other' END AS error_type, event_type || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' para archivo f' || event_id || '.json: x' ELSE ' para f' || event_id || '.json' END || chr(10) || '  ' || CASE event_id % 4 WHEN 0 THEN 'TypeError, not ValueError' WHEN 1 THEN 'NameError' WHEN 2 THEN 'ValueError' ELSE 'nothing' END AS message FROM events")
def error_log_entries(t):
    k = F.col("event_id")
    file = F.concat(F.lit("f"), k.cast("string"), F.lit(".json"))
    named = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(" para archivo "), file, F.lit(": x"))).otherwise(F.concat(F.lit(" para "), file))
    kind = F.when(k % 4 == 0, "TypeError, not ValueError").when(k % 4 == 1, "NameError").when(k % 4 == 2, "ValueError").otherwise("nothing")
    entry = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" "), "event_type", named, F.lit("\n  "), kind)
    logs = t("events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", entry.alias("e")))).alias("_e"))
    return jobs.log_entries(logs.select(F.concat(F.lit("no time stamp\n"), F.array_join("_e.e", "\n")).alias("log")), "log")


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
_PDF_LINES = f"w AS (SELECT item_id, {_WORDS} AS w FROM benchmark), l AS (SELECT item_id, unnest(range(0, CAST(ceil(len(w) / 6.0) AS BIGINT))) AS i, w FROM w), p AS (SELECT item_id AS id, i // 3 + 1 AS page, i % 3 AS pos, array_to_string(w[i * 6 + 1 : i * 6 + 6], ' ') AS text FROM l)"


def _made(t, make):
    """(path, content) of files made from the benchmark's texts, lines of six words."""
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / 6).cast("int")), lambda i: F.array_join(F.slice("_w", i * 6 + 1, 6), " "))
    rows = t("benchmark").withColumn("_w", F.filter(F.split("text", r"\s+"), lambda w: w != "")).where(F.size("_w") > 0).select(F.col("item_id").cast("string").alias("path"), lines.alias("lines"))

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "content": [make(str(p), list(x)) for p, x in zip(part["path"], part["lines"])]})

    ship(rows.sparkSession)
    return rows.mapInPandas(run, "path string, content binary")


def _made_pdf(path, lines):
    return made_files.pdf([lines[i : i + 3] for i in range(0, len(lines), 3)], f"Obra ({path})", "Ana Núñez")


def _made_docx(path, lines):
    return made_files.docx(f"Obra {path}", lines, "Ana Núñez")


@query("SRC-17", f"WITH {_PDF_LINES} SELECT CAST(id AS VARCHAR) AS path, CAST(page AS INTEGER) AS page, CAST(pos AS INTEGER) AS pos, text, CASE WHEN pos = 0 THEN 18.0 ELSE 11.0 END::DOUBLE AS size FROM p")
def pdf_lines(t):
    return files.pdf_files(_made(t, _made_pdf))


@query("SRC-25 SRC-35", f"WITH {_PDF_LINES}, a AS (SELECT id, page, pos, text, CASE WHEN pos = 0 THEN 18.0 ELSE 11.0 END AS size FROM p), b AS (SELECT *, avg(size) OVER (PARTITION BY id) AS av FROM a), g AS (SELECT id, page, string_agg(CASE WHEN size > av * 1.2 THEN '## ' ELSE '' END || text, chr(10) ORDER BY pos) AS text FROM b GROUP BY id, page) SELECT CAST(id AS VARCHAR) AS path, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM g GROUP BY id")
def pdf_as_markdown(t):
    return files.pdf_markdown(_made(t, _made_pdf))


@query("SRC-35", f"WITH {_PDF_LINES} SELECT CAST(id AS VARCHAR) AS path, 'Obra (' || id || ')' AS title, 'Ana Núñez' AS author, '2024-01-02' AS date, CAST(max(page) AS INTEGER) AS n_pages FROM p GROUP BY id")
def pdf_metadata(t):
    return files.pdf_properties(_made(t, _made_pdf))


@query("SRC-36 SRC-15", f"WITH {_PDF_LINES}, b AS (SELECT id, page * 3 + pos AS i, text, {restated.is_heading('text')} AS head, {restated.heading_level('text')} AS level FROM p) SELECT CAST(id AS VARCHAR) AS path, '## Obra ' || id || chr(10) || chr(10) || string_agg(CASE WHEN head THEN repeat('#', level) || ' ' ELSE '' END || text, chr(10) || chr(10) ORDER BY i) AS text FROM b GROUP BY id")
def docx_as_markdown(t):
    return files.docx_markdown(_made(t, _made_docx))


@query("SRC-15", f"WITH {_PDF_LINES} SELECT DISTINCT CAST(id AS VARCHAR) AS path, 'Obra ' || id AS title, 'Ana Núñez' AS author FROM p")
def docx_metadata(t):
    return files.docx_properties(_made(t, _made_docx)).select("path", "title", "author")


@query(
    "AUT-32",
    "WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Ana López Ruiz' ELSE 'Pedro Gómez' END AS name, (doc_id % 10 + 1) / 10.0::DOUBLE AS confidence FROM documents), p(k, person) AS (VALUES (0, 'ana lópez ruiz'), (0, 'otra persona'), (1, 'pedro antonio'), (2, 'ana maría del río'), (3, 'pedro gómez'), (4, 'luis'))"
    " SELECT doc_id, name, coalesce(bool_or(person = lower(name)), false) OR coalesce(bool_or(h), false) AS ner_validated, round(any_value(CASE WHEN e THEN least(confidence * 1.2, 1.0) WHEN q THEN least(confidence * 1.1, 1.0) ELSE confidence * 0.95 END), 6)::DOUBLE AS confidence"
    " FROM (SELECT *, coalesce(bool_or(person = lower(name)) OVER (PARTITION BY doc_id), false) AS e, coalesce(bool_or(h) OVER (PARTITION BY doc_id), false) AS q FROM (SELECT c.*, person, len(list_intersect(string_split(lower(name), ' '), string_split(person, ' '))) AS n,"
    " len(list_intersect(string_split(lower(name), ' '), string_split(person, ' '))) >= greatest(1, len(string_split(person, ' ')) * 0.5) AS h FROM c LEFT JOIN p ON p.k = doc_id % 6)) GROUP BY doc_id, name",
)
def author_person_validated(t):
    d = t("documents")
    c = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Ana López Ruiz").otherwise("Pedro Gómez").alias("name"), ((F.col("doc_id") % 10 + 1) / 10).alias("confidence"))
    known = {0: ["Ana López Ruiz", "Otra Persona"], 1: ["Pedro Antonio"], 2: ["Ana María del Río"], 3: [" pedro GÓMEZ"], 4: ["Luis"]}
    per = F.coalesce(*[F.when(F.col("doc_id") % 6 == k, F.array(*[F.lit(x) for x in xs])) for k, xs in known.items()])
    persons = d.select("doc_id", F.explode(per).alias("person"))
    return authors.person_validated(c, "doc_id", "name", "confidence", persons, "person").select("doc_id", "name", "ner_validated", F.round("confidence", 6).alias("confidence"))
