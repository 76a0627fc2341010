"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import decontaminate, language_id, license_scan, line_quality, mixing, passage_dedup, sharding, simhash_dedup, token_count, url_filter

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_docs(spark, sf_dir), tokenizer_path())


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return line_quality.judge(docs, line_quality.fit_on(docs, _read(spark, sf_dir, "labels")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return language_id.identify(docs, language_id.learn(docs))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_docs(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_docs(spark, sf_dir))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_docs(spark, sf_dir), _read(spark, sf_dir, "benchmark"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_passages(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": op1_mix,
        "op2_url_filter": op2_url_filter,
        "op3_token_counts": op3_token_counts,
        "op4_line_quality": op4_line_quality,
        "op5_language": op5_language,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_licenses": op7_licenses,
        "op8_shards": op8_shards,
        "op9_decontaminate": op9_decontaminate,
        "op10_repeated_passages": op10_repeated_passages,
        "pipeline": pipeline,
    }


_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
_FITS = "FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) ORDER BY length(r.host) DESC, length(r.path) DESC LIMIT 1"

OP2_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {_RULES}),
p AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
)
SELECT page_id, host, path,
       (SELECT r.host || r.path {_FITS}) AS rule,
       coalesce((SELECT r.verdict {_FITS}), 'allow') AS verdict
FROM p
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the method; the other queries are held against brute force in tests/llm."""
    return {"op2_url_filter": OP2_SQL}
