"""SimHash near-duplicates: fingerprints meet at the words of a covering code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.components import connected
from textlake.llm.runtime import drop_extra, materialize, numbered

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: The covering code: all 64-bit words whose first 63 bits are a word of the Hamming code of length 63 (any
#: last bit). Its covering radius is 1: bit i has check value i + 1, and flipping one bit mends any check sum.
RADIUS = 1
#: Fingerprints link at this many differing bits or fewer; half of it, from both sides, is what an anchor
#: has to reach, as two linked fingerprints have a point between them that is within 1 of each.
THRESHOLD = 2
_SLAB = 1 << 18


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit by bit, whether it is set in over half of the hashes of the text's shingles; no words: 0."""
    words = WORD.findall(text.encode("utf-8", "replace").lower()) if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, digest, seed = b" ".join(words), xxhash.xxh64_intdigest, SEED
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    first, last = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLAB):
        h = np.array([digest(line[a:b], seed) for a, b in zip(first[at : at + _SLAB], last[at : at + _SLAB])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # rows are added in blocks of 255, the most that a byte can count
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row of ``docs``, each text read where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    d = drop_extra(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _flips() -> list[np.ndarray]:
    """For each check sum, the flips of at most RADIUS + THRESHOLD / 2 = 2 bits that lead to a word of the code."""
    last = 1 << 63
    out = [np.array([0, last], np.uint64)]
    for check in range(1, 64):
        one = 1 << (check - 1)
        pairs = [(1 << (a - 1)) | (1 << ((a ^ check) - 1)) for a in range(1, 64) if a < a ^ check < 64]
        out.append(np.array([one, one | last, *pairs], np.uint64))
    return out


FLIPS = _flips()


def checks(fp: np.ndarray) -> np.ndarray:
    total = np.zeros(len(fp), np.int64)
    for i in range(63):
        total ^= ((fp >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i + 1)
    return total


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) for every word of the code within distance 2 of each fingerprint: 33 or 2 each."""
    sums = checks(fp)
    own, at = [], []
    for check in np.unique(sums):
        mine = fp[sums == check]
        at.append((mine[:, None] ^ FLIPS[check][None, :]).ravel())
        own.append(np.repeat(mine, len(FLIPS[check])))
    return np.concatenate(at), np.concatenate(own)


def forest(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints at one anchor, by comparing all of them."""
    n = len(fps)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= threshold) + i + 1
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((i, j))
    return out


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints that join the same fingerprints as all links do.

    An anchor gathers the distinct fingerprints within 2 bits of it, of which there are 2081, whatever the
    table; each pair at 2 bits or fewer meets at some anchor, so none is lost.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if len(fp):
                at, own = anchors(fp)
                for i in range(0, len(at), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)].view(np.int64), pa.int64()) for x in (at, own)], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for own in batch.column(0).to_pylist():
                fp = np.array(own, np.int64)
                for i, j in forest(fp.view(np.uint64)):
                    a.append(own[i])
                    b.append(own[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    met = fps.select("fp").mapInArrow(spread, "anchor long, fp long").groupBy("anchor").agg(F.collect_list("fp").alias("fps"))
    return met.where(F.size("fps") > 1).select("fps").mapInArrow(compare, "a long, b long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def components_of(own: DataFrame) -> DataFrame:
    """(fp, first: its least doc_id, root: the least fingerprint of its component) for each fingerprint of ``own``."""
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    star = connected(links(distinct))
    named = distinct.join(star.select(F.col("u").alias("_u"), F.col("v").alias("_root")), F.col("fp") == F.col("_u"), "left")
    return named.select("fp", "first", F.coalesce("_root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    Copies share a fingerprint and are carried as one; distinct fingerprints are replicated to the words of
    a covering code (at most 33 each) and compared anchor by anchor; components grow over the links found.
    component_id is the smallest doc_id of the component (null only if all its ids are null).

    Null text, or no word: fingerprint 0, linked like any other. Fewer words than a shingle: the whole
    sequence is one. Repeated rows and ids: each row is returned. Empty table: no rows.
    """
    own = materialize(fingerprints(docs, shingle))
    named = components_of(own)
    least = named.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "_root")
    groups = materialize(named.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"))
    return own.join(groups, F.col("fp") == F.col("_fp")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, all columns as they were: of each component one row, that
    of the smallest doc_id.

    Rows count one by one: of rows that repeat the smallest id the first as read stays, rows of one id whose
    texts don't link are in components of their own, and rows without an id come last in theirs. Null and empty
    texts, ties and an empty table as in ``near_duplicates``. Extra columns may have any names.
    """
    rows = numbered(docs)
    own = materialize(fingerprints(rows.select(F.struct(F.col("row.doc_id").isNull().alias("a"), F.col("row.doc_id").alias("b"), "n").alias("doc_id"), "row.text"), shingle))
    groups = components_of(own)
    stay = materialize(groups.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.n").alias("_n")))
    # the rows to keep grow with the table: one plan at every size, no broadcast where they happen to be few
    return rows.join(stay.hint("merge"), F.col("n") == F.col("_n"), "left_semi").select("row.*")
