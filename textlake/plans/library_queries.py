"""Library, registry and job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import jobs, library, registry
from textlake.plans.registry import query


@query("AGG-01", "SELECT source AS file_type, count(*) AS n FROM documents GROUP BY source")
def library_stats_by_type(t):
    return library.by_type(t("documents"), "source")


@query("AGG-01 SRT-04 FLT-09 SRT-12", "SELECT source AS author, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY source ORDER BY n DESC, author LIMIT 10")
def library_top_authors(t):
    return library.top_authors(t("documents"), "source", "src0")


@query("AGG-01 AGG-19", r"SELECT count(*) AS documents, CAST(sum(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))) AS BIGINT) AS words FROM documents")
def library_total_words(t):
    return library.totals(t("documents"), "text")


@query("SRT-02 STR-15 SRT-06", "SELECT doc_id, source, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def library_list_page(t):
    d = library.page(t("documents"), [F.desc("n_chars"), F.col("doc_id")], 20, 40)
    return d.select("doc_id", "source", T.preview(F.col("text")).alias("preview"))


@query("FLT-08", "SELECT doc_id FROM documents WHERE source ILIKE '%src1%' OR left(text, 200) ILIKE '%the on%'")
def library_search_like(t):
    d = t("documents").withColumn("content_preview", F.left("text", F.lit(200)))
    return library.search(d, "src1", "source").unionByName(library.search(d, "the on", "content_preview")).select("doc_id").distinct()


@query("MTH-03 RDR-06", r"SELECT doc_id, CAST(greatest(ceil(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) / 250.0), 1) AS BIGINT) AS pages FROM documents")
def document_pages_estimate(t):
    return t("documents").select("doc_id", library.reading_pages(T.word_count(F.col("text"))).alias("pages"))


@query("AGG-17 SRT-06", "SELECT count(*) AS total, CAST(ceil(count(*) / 12.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 12.0) AS has_next, true AS has_prev FROM documents")
def library_page_info(t):
    return library.page_info(t("documents"), 3, 12)


@query("FLT-14 FLT-15", "SELECT doc_id, source, lang FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' AND source IN ('src1', 'src2', 'src3')")
def documents_filter(t):
    return library.filtered(t("documents"), "THE", ("text",), {"lang": "en"}, {"source": ["src1", "src2", "src3"]}).select("doc_id", "source", "lang")


@query("FLT-15 WIN-09", "SELECT conv_id, turn, progress FROM (SELECT conv_id, turn, round(row_number() OVER (PARTITION BY conv_id ORDER BY turn) * 100.0 / count(*) OVER (PARTITION BY conv_id), 4) AS progress FROM conversations) WHERE progress > 0 AND progress < 100")
def library_in_progress(t):
    from textlake.operators import reader

    return library.filtered(reader.progress(t("conversations"), "conv_id", "turn"), status="in-progress").select("conv_id", "turn", "progress")


@query("AGG-18", "SELECT count(DISTINCT lang) AS languages, count(DISTINCT source) AS authors FROM documents")
def library_facets(t):
    return t("documents").agg(F.countDistinct("lang").alias("languages"), F.countDistinct("source").alias("authors"))


@query("JOI-03", "SELECT d.doc_id, coalesce(l.n, 0) AS annotations, coalesce(c.n, 0) AS segments FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id) LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1) c USING (doc_id)")
def doc_list_join(t):
    turns = t("conversations").withColumnRenamed("conv_id", "doc_id")
    return library.with_counts(t("documents").select("doc_id"), "doc_id", annotations=t("labels"), segments=turns)


@query("FLT-13", "SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR contains('src1', lower(source)) OR contains(lower(source), 'src25') OR contains('src25', lower(source))")
def author_filter(t):
    return t("documents").where(library.author_matches(F.col("source"), ["SRC1", "src25"])).select("doc_id")


@query("SRT-11 RDR-09", "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 10")
def recent_list(t):
    return library.recent(t("events"), "user_id", "ts")


@query("RDR-08", "SELECT o.o_custkey AS c_custkey FROM (SELECT DISTINCT o_custkey + 10 AS o_custkey FROM orders) o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey FROM customer")
def author_upsert(t):
    rows = t("orders").select((F.col("o_custkey") + 10).alias("c_custkey")).distinct()
    return library.insert_missing(t("customer").select("c_custkey"), rows, "c_custkey")


@query("RDR-07 SNK-13", "SELECT doc_id, 9 AS quality FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, quality FROM labels WHERE toxic <> 1")
def annotation_update(t):
    rows = t("labels").where("toxic = 1").select("doc_id", F.lit(9).alias("quality"))
    return library.upsert(t("labels").select("doc_id", "quality"), rows, "doc_id")


@query("FLT-17", "SELECT conv_id, CAST(count(*) AS BIGINT) AS notes FROM conversations WHERE contains(lower(role), 'the') OR contains(lower(text), 'the') GROUP BY conv_id")
def notebook_filter(t):
    sections = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("title"), F.col("text").alias("content"))).alias("notes"))
    return library.notes_containing(sections, "notes", "the").select("conv_id", F.size("notes").cast("long").alias("notes"))


@query("FLT-16 SRT-08", "SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY conv_id, turn")
def annotation_list(t):
    return t("conversations").where("role = 'user'").select("conv_id", "turn").orderBy("conv_id", "turn")


@query("SET-03", "SELECT doc_id, sha256(text) AS hash FROM documents")
def registry_hash(t):
    return t("documents").select("doc_id", registry.content_hash(F.col("text")).alias("hash"))


@query("SET-04", "SELECT doc_id, sha256(text) AS hash, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_new FROM documents")
def registry_first_seen(t):
    return registry.first_seen(t("documents"), "text", "doc_id").select("doc_id", "hash", "is_new")


@query("SET-06 SET-07", "SELECT sha256(text) AS hash, doc_id, copy_of, n_copies FROM (SELECT text, doc_id, min(doc_id) OVER (PARTITION BY text) AS copy_of, count(*) OVER (PARTITION BY text) AS n_copies FROM documents) WHERE doc_id <> copy_of")
def registry_duplicates_report(t):
    return registry.duplicates(t("documents"), "text", "doc_id")


def _events(t):
    e = t("events")
    return e.select(F.col("event_id").cast("string").alias("hash"), F.col("event_type").alias("file_path"), F.col("props").alias("title"), F.col("ts").alias("first_seen"))


@query("AGG-02", "SELECT count(*) AS total, min(ts) AS oldest, max(ts) AS newest FROM events")
def registry_stats(t):
    return registry.stats(_events(t))


@query("SRT-01 FLT-07 DAT-07 SEA-12", "SELECT CAST(event_id AS VARCHAR) AS hash, ts AS first_seen FROM events WHERE (props ILIKE '%1%' OR event_type ILIKE '%1%') AND ts > (SELECT min(ts) FROM events) AND ts < TIMESTAMP '2100-01-01' ORDER BY ts DESC, hash LIMIT 25")
def registry_range_list(t):
    e = _events(t)
    first = str(e.agg(F.min("first_seen")).first()[0])
    return registry.listed(e, "1", "2100-01-01", first, 25).select("hash", "first_seen")


@query("SRT-05", "SELECT CAST(event_id AS VARCHAR) AS hash FROM events ORDER BY ts DESC, hash LIMIT 1000 OFFSET 30")
def registry_list_clamped(t):
    return registry.listed(_events(t), limit=5000, offset=30).select("hash")


@query("SET-09 SET-10 SET-08", "SELECT CAST(event_id AS VARCHAR) AS hash FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def registry_prune(t):
    return registry.pruned(_events(t), "2024-01-15").select("hash")


@query("SET-08", "SELECT CAST(event_id AS VARCHAR) AS hash FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id = 0)")
def registry_delete_by_path(t):
    e = _events(t)
    return registry.without(e, e.where("hash = '0'"), "file_path").select("hash")


@query("SET-11", "SELECT w.hash, CASE WHEN e.event_id IS NULL THEN 'not_found' ELSE 'deleted' END AS outcome FROM (SELECT CAST(c_custkey * 100 AS VARCHAR) AS hash FROM customer) w LEFT JOIN events e ON CAST(e.event_id AS VARCHAR) = w.hash")
def registry_batch_delete_report(t):
    wanted = t("customer").select((F.col("c_custkey") * 100).cast("string").alias("hash"))
    return registry.delete_report(_events(t), wanted)


@query("SET-05 JOI-05", "SELECT sha256(text) AS hash, min(source) AS file_path FROM documents GROUP BY text")
def registry_register(t):
    d = t("documents").select(registry.content_hash(F.col("text")).alias("hash"), F.col("source").alias("file_path"), F.lit(None).cast("string").alias("title"), F.lit("2024-01-01").cast("timestamp").alias("first_seen"))
    seen = d.where("file_path = 'src0'").groupBy("hash").agg(F.min("file_path").alias("file_path"), F.min("title").alias("title"), F.min("first_seen").alias("first_seen"))
    return registry.register(seen, d).select("hash", "file_path")


@query("JOI-05 EMB-04", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dedup_anti_join_new(t):
    return t("documents").join(t("labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SET-12", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_ids(t):
    return registry.missing_ids(t("documents"), t("labels"), "doc_id")


@query("SET-13", r"SELECT sha256(lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')))) AS norm_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_normalised_text(t):
    return registry.distinct_texts(t("documents"), "text", "doc_id")


@query("AGG-03", "SELECT event_type AS result_code, count(*) AS n FROM events GROUP BY 1")
def processing_results(t):
    return jobs.by_result(t("events"), "event_type")


@query("AGG-04 AGG-05", "SELECT event_type, round(avg(value), 6) AS avg_s, min(value) AS min_s, max(value) AS max_s, round(count(*) / sum(value) * 60, 6) AS per_minute FROM events GROUP BY 1")
def processing_throughput(t):
    return jobs.timing(t("events"), "event_type", "value").select("event_type", F.round("avg_s", 6).alias("avg_s"), "min_s", "max_s", F.round("per_minute", 6).alias("per_minute"))


@query("AGG-04", "SELECT event_type, min_by(event_id, (value, event_id)) AS fastest, max_by(event_id, (value, event_id)) AS slowest FROM (SELECT event_type, event_id, value FROM events) GROUP BY 1")
def processing_extremes(t):
    return jobs.extremes(t("events"), "event_type", "value", "event_id")


@query("AGG-06 SRT-12", "SELECT event_type AS error_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 4) AS percent FROM events GROUP BY 1")
def error_report(t):
    return jobs.error_share(t("events"), "event_type")


@query("AGG-07", r"SELECT regexp_extract(url, '\.[^./]+$') AS extension, count(*) AS n FROM pages GROUP BY 1")
def errors_by_extension(t):
    return jobs.by_extension(t("pages"), "url")


@query("AGG-08 AGG-21", "SELECT source AS file, count(*) AS entries FROM documents GROUP BY source")
def entries_per_file(t):
    return t("documents").groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("entries"))


@query("AGG-08", "SELECT count(DISTINCT source) AS files, count(*) AS entries, round(count(*) / count(DISTINCT source), 4) AS per_file FROM documents")
def unify_stats(t):
    return t("documents").agg(F.countDistinct("source").alias("files"), F.count(F.lit(1)).alias("entries"), F.round(F.count(F.lit(1)) / F.countDistinct("source"), 4).alias("per_file"))


@query("STM-02 STM-03", "SELECT user_id AS job, max_by(event_type, (ts, event_id)) AS status, count(*) AS steps FROM events GROUP BY 1")
def job_status(t):
    return jobs.latest(t("events"), "user_id", "event_type", "ts", "event_id")


@query("STR-16 STR-17")
def format_sizes(t):
    return t("documents").select("doc_id", T.format_size(F.col("n_chars")).alias("size"), T.format_duration(F.col("n_chars") / 100.0 + 0.001).alias("duration"))
