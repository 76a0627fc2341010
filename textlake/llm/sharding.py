"""Sharding by cutting runs of a Hilbert curve over document metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textlake.llm.ordering import globally_sorted, with_position
from textlake.llm.runtime import drop_extra, materialize

BITS = 8
#: Ranks of more distinct values than this are joined by a shuffle instead of a broadcast.
BROADCAST_VALUES = 100_000
#: Parts that the rows of a text with copies are dealt over when they look up their common place.
SALTS = 16


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``axes`` (n, dims), coordinates of ``bits`` bits.

    Gray-code walk from the coarsest bit down: a level reflects or swaps the finer bits of the axes, then the
    levels' bits are interleaved.
    """
    x = [axes[:, d].astype(np.int64) for d in range(axes.shape[1])]
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        finer = (1 << level) - 1
        for d in range(dims):
            flip = (x[d] >> level) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[d]) & finer)
            x[0] = np.where(flip, x[0] ^ finer, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    parity = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        parity = np.where((x[-1] >> level) & 1 == 1, parity ^ ((1 << level) - 1), parity)
    x = [a ^ parity for a in x]
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | ((a >> level) & 1)
    return out


@F.pandas_udf(LongType())
def _hilbert(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.column_stack([a.to_numpy(), b.to_numpy(), c.to_numpy()])))


def _ranked(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds ``out``: the rank of the text column ``name`` among its distinct values, scaled to the curve's cells.
    Ranks come from range partitions, so any number of values is ordered."""
    cells = (1 << BITS) - 1
    values = with_position(globally_sorted(df.select(F.col(name).alias("_v")).distinct(), [F.col("_v").asc_nulls_last()]))
    scale = F.floor(F.col("_pos") * F.lit(cells) / F.greatest(F.col("_total") - 1, F.lit(1))).cast("long")
    table = values.select("_v", scale.alias(out))
    if table.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
        table = F.broadcast(table)
    return df.join(table, F.col(name).eqNullSafe(F.col("_v"))).drop("_v")


def _together(d: DataFrame) -> DataFrame:
    """Rows of one text at one place of the curve: the first of their places. Only texts with several places are
    looked up, and the rows of a text are dealt over SALTS parts, so many copies don't meet in one task."""
    d = materialize(d)
    several = d.groupBy("text_hash").agg(F.min("curve").alias("_first"), F.max("curve").alias("_last")).where("_first < _last")
    several = several.select(F.col("text_hash").alias("_h"), "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("doc_id", "curve"), F.lit(SALTS)).cast("int")
    met = d.join(several, (F.col("text_hash") == F.col("_h")) & (salt == F.col("_salt")), "left")
    return met.withColumn("curve", F.coalesce("_first", "curve")).drop("_h", "_first", "_salt")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve for every row of ``docs``.

    Language, source and size are quantised to 256 cells each (texts by rank among distinct values, size by
    its logarithm) and ordered along a Hilbert curve; equal texts stand together at the first of their places,
    so a group of copies lies in one shard, or in neighbours where a cut falls into it. Shard s is the s-th of
    ``shards`` equal runs, so shards cover compact boxes of the three dimensions and readers prune by file
    statistics. Law ``rows``: counts differ by one at most; slots number a shard's rows from 0.

    Null text: no bytes, checksum 0. Null language or source: a value of its own, after the others. Ties:
    by checksum and hash of the text, then doc_id; rows equal in all that are interchangeable. Empty table: no
    rows. Fewer rows than shards: some shards stay empty. Extra columns of any name are left alone.
    """
    d = drop_extra(docs, "doc_id", "lang", "source", "text").select(
        "doc_id", "lang", "source", text_bytes(F.col("text")).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64("text").alias("text_hash"),
    )
    d = _ranked(_ranked(d, "lang", "_x"), "source", "_y")
    z = F.least(F.floor(F.log2(F.col("size").cast("double")) * F.lit(8.0)), F.lit((1 << BITS) - 1)).cast("long")
    d = d.withColumn("curve", _hilbert("_x", "_y", z)).drop("_x", "_y", "lang", "source")
    placed = with_position(globally_sorted(_together(d), [F.col("curve"), F.col("text_crc32"), F.col("text_hash"), F.col("doc_id")]))
    number = F.floor(F.col("_pos") * F.lit(shards) / F.col("_total")).cast("long")
    # exact integer arithmetic: run s starts at ceil(s * total / shards)
    start = lambda s: F.expr(f"div({s} * _total + {shards - 1}, {shards})")
    placed = placed.withColumn("_s", number)
    placed = placed.withColumn("_s", F.expr(f"CASE WHEN div(_s * _total + {shards - 1}, {shards}) > _pos THEN _s - 1 WHEN div((_s + 1) * _total + {shards - 1}, {shards}) <= _pos THEN _s + 1 ELSE _s END"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_s").cast("int").alias("shard"),
        (F.col("_pos") - start("_s")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
