"""Durable lineage cuts shared by the operators.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``: every executor
can read it, so a lost executor costs only its running tasks. Only where the setting is absent (tests, a
laptop) a folder of this process is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.shipping import ship

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="textlake-"))
    return _OWN[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage that survives
    executors, with file statistics for the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.textlake_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and that no later step reads."""
    for table in tables:
        spark, path = table.sparkSession, table.textlake_path
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sweep(spark: SparkSession) -> None:
    """Has the driver collect what nothing refers to any more, upon which Spark drops the shuffles of finished jobs
    on all executors: between steps that each shuffle about as much as there is input."""
    spark._jvm.System.gc()


def numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """(row: all columns of ``docs`` as one struct, n: a number of the row, ``more``), written once so that the
    numbers hold. Inside the struct columns of any name can't clash with an operator's own."""
    ship(docs.sparkSession)
    return materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n"), *more))


def drop_extra(df: DataFrame, *needed: str) -> DataFrame:
    """Only the columns an operator reads, so extra columns of any name can't clash with its own."""
    ship(df.sparkSession)
    return df.select(*[df[c] for c in needed])
