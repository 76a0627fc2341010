"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, mixture, shards.

Each stage reads what its predecessor wrote. All but the last return the columns of ``documents``, extra ones of any
name included. Every stage goes by rows: equal rows and rows that share an id, or have none, are told apart. Null,
empty and blank texts have no words: ``quality`` drops them; by themselves the later stages take them as one group of
near duplicates, as holding no benchmark item, as no copy of the mix and as the smallest rows of a shard. An empty
table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlake.llm import decontaminate, line_quality, mixing, sharding, simhash_dedup
from textlake.llm.runtime import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labels and base rules reject go; the labels table trains the field (without labels
    of both kinds the default weights hold). Ties between labels: content."""
    return line_quality.keep(docs, line_quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, of rows with that id the first."""
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, row by row; an empty benchmark takes none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes of them; null sources are one source, ties go by the row."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix; copies of a text are neighbours."""
    return sharding.shard(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: No SQL: a trained line labelling, transitive fingerprint links and an ordered sample are not expressible;
#: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
