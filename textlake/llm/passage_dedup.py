"""Repeated passages: paragraph MinHash banding, exact verification, removal by components.

Paragraphs are the lines of a text, and, as passages also stand inside longer lines, windows of PARAGRAPH
words. A window begins at the MinHash of a run of RUN neighbouring shingles, so that two texts choose the same
places inside a passage that they share: of any verbatim run of PARAGRAPH + RUN - 1 = 30 words or more at least
one window is in both, and it is their common key: copies agree in all minima. Near copies of a passage inside
longer lines are found by the windows of the verbatim runs between their changes: c changed words leave
five-word shingles at 0.8 Jaccard only from 45 c + 4 words on, so that the longest run between them has 30
words at least, unless c is 1 and the passage is shorter than 60 words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textlake.llm.components import connected
from textlake.llm.runtime import discard, drop_extra, materialize, numbered, sweep

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words of a window, and of a line at least, to count as a paragraph.
PARAGRAPH = 20
#: Neighbouring starts of which one at least begins a window.
RUN = 11
SHINGLE = 5
#: BANDS bands of ROWS minima: two paragraphs at similarity 0.8 meet in a band with probability 0.993.
BANDS, ROWS = 7, 3
#: Lines, and shingles of lines, of a bucket that are compared as one group; larger buckets are divided, none is cut.
TOGETHER = 256
SHINGLES_TOGETHER = 1 << 20
#: Lines that each line of a larger bucket is held against, and how many pairs of lines far from them with any lines of
#: their bucket are compared without dividing it.
PIVOTS, FEW = 6, 4_000_000
#: Bytes of a shingle's hash in a set: two lines of a and b shingles have a * b / 2**40 in common by chance.
BYTES = 5

_rng = np.random.default_rng(20240501)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_POWERS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PARTS = [*range(0, PARAGRAPH - SHINGLE, SHINGLE), PARAGRAPH - SHINGLE]
_PART_POWERS = _rng.integers(1, 1 << 63, (2, len(_PARTS)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_ROWS = [list(range(b * ROWS, (b + 1) * ROWS)) for b in range(BANDS)]
#: Keys of two neighbouring minima: two lines at similarity 0.8 have none in common with probability below 1e-6.
_FINER_ROWS = [[i, i + 1] for i in range(BANDS * ROWS - 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _places(keys: np.ndarray, run: int) -> np.ndarray:
    """Starts chosen by content: the minimum of every ``run`` neighbours, or of all where there are fewer."""
    if len(keys) <= run:
        return np.array([int(keys.argmin())])
    view = np.lib.stride_tricks.sliding_window_view(keys, run)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def _shingles(text: str | None) -> tuple[list[bytes], list[tuple[int, int]], np.ndarray]:
    """The words of ``text``, first word and words of its lines of PARAGRAPH words or more, and the hashes of its
    shingles; all empty where it is shorter than a paragraph."""
    words: list[bytes] = []
    lines: list[tuple[int, int]] = []
    for line in text.encode("utf-8", "replace").lower().split(b"\n") if text else ():
        own = WORD.findall(line)
        if len(own) >= PARAGRAPH:
            lines.append((len(words), len(own)))
        words += own
    n = len(words)
    if n < PARAGRAPH:
        return [], [], np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    grams = n - SHINGLE + 1
    h = w[:grams] * _POWERS[0]
    for j in range(1, SHINGLE):
        h = h + w[j : j + grams] * _POWERS[j]
    return words, lines, _mix(h)


def windows_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and second, shorter hash of each window of a text whose shingles hash to ``h``."""
    at = _places(h[: len(h) + SHINGLE - PARAGRAPH], RUN)
    hashes = [np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)]
    for part, powers in zip(_PARTS, _PART_POWERS.T):
        mine = h[at + part]
        hashes = [x + mine * p for x, p in zip(hashes, powers)]
    return at.astype(np.int32), _mix(hashes[0]).view(np.int64), (_mix(hashes[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def lines_of(words: list[bytes], lines: list[tuple[int, int]], h: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """First word, words, hash and shingle set of each line."""
    out = []
    for start, size in lines:
        own = int.from_bytes(xxhash.xxh3_64_digest(b" ".join(words[start : start + size])), "big", signed=True)
        out.append((start, size, own, np.unique(h[start : start + size - SHINGLE + 1] >> np.uint64(64 - 8 * BYTES))))
    return out


def packed(shingles: np.ndarray) -> bytes:
    return shingles.view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(sets: bytes) -> np.ndarray:
    out = np.zeros((len(sets) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(sets, np.uint8).reshape(-1, BYTES)
    return out.view(np.uint64).ravel()


def _set(value: pa.BinaryScalar) -> frozenset:
    return frozenset(unpacked(value.as_py()).tolist())


def minima(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS * ROWS) MinHash values of sets that lie end to end; none is empty."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return np.stack([np.minimum.reduceat(_mix(flat * a + b), first) for a, b in zip(_MULTIPLY, _ADD)], axis=1)


def _keys(values: np.ndarray, groups: list[list[int]], salt: np.ndarray | None = None) -> np.ndarray:
    """A key for each paragraph and group of its minima; ``salt`` keeps keys of different buckets apart."""
    out = np.zeros((len(values), len(groups)), np.uint64)
    for g, rows in enumerate(groups):
        key = np.full(len(values), np.uint64(g + 1)) if salt is None else salt + np.uint64(g + 1)
        for r in rows:
            key = _mix(key * np.uint64(0x100000001B3) ^ values[:, r])
        out[:, g] = key
    return out


def _similar(a: frozenset, b: frozenset, similarity: float) -> bool:
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both)


def _forest(sets: list[frozenset], similarity: float, joined: list[bool]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of at least ``similarity`` Jaccard, comparing all not yet joined; those
    ``joined`` are so from the outset."""
    first = joined.index(True) if True in joined else 0
    root = [first if j else i for i, j in enumerate(joined)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if similarity * len(sets[j]) > len(sets[i]):
                break
            if find(i) != find(j) and _similar(sets[i], sets[j], similarity):
                root[find(i)] = find(j)
                out.append((i, j))
    return out


def _verify(groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b) from groups of (h, s, near) of bounded size; those near are joined already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                hashes, sets = batch.column(0)[at].as_py(), [_set(s) for s in batch.column(1)[at]]
                pairs = _forest(sets, similarity, batch.column(2)[at].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([hashes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    packed = groups.groupBy("key").agg(F.collect_list(F.struct("h", "s", "near")).alias("m")).where(F.size("m") > 1)
    return packed.select(F.col("m.h").alias("hs"), F.col("m.s").alias("ss"), F.col("m.near").alias("nears")).mapInArrow(run, "a long, b long")


def _counted(members: DataFrame) -> DataFrame:
    """(key, h, m, near) with the lines ``c`` and shingles ``t`` of their bucket, where it has several lines that
    aren't all near."""
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("m").alias("t"), F.bool_and("near").alias("done")).where("c > 1 AND NOT done").drop("done")
    counts = counts.withColumnRenamed("key", "_key")
    return members.join(counts, F.col("key") == F.col("_key")).drop("_key")


def _fits() -> Column:
    return (F.col("c") <= TOGETHER) & ((F.col("t") <= SHINGLES_TOGETHER) | (F.col("c") == 2))


def _beside_pivots(large: DataFrame, sets: DataFrame, similarity: float, fitness: Column) -> DataFrame:
    """(key, h, s, m, mask, pivots) of buckets (key, h, m) of any size: each line is held against PIVOTS lines of its
    bucket, of those of the least ``fitness``, and has a bit in ``mask`` for each that it is similar to. ``sets``: (_h, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, []
        for batch in batches:
            masks = []
            for k, s, pivots in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(5)):
                if k != key:
                    key, known = k, [_set(p) for p in pivots]
                own = _set(s)
                masks.append(sum(1 << i for i, p in enumerate(known) if _similar(own, p, similarity)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(masks, pa.int32()), batch.column(4)], ["key", "h", "s", "m", "mask", "pivots"])

    least = [F.min(F.struct(fitness.alias("f"), F.xxhash64("h", F.lit(i)).alias("o"), F.col("h").alias("h")))["h"].alias(f"p{i}") for i in range(PIVOTS)]
    pivots = large.groupBy("key").agg(*least).select(F.col("key").alias("_key"), F.posexplode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("i", "p"))
    packs = pivots.join(sets, F.col("p") == F.col("_h")).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("i", "p", "s"))).alias("x"))
    packs = packs.select("_key", F.col("x.p").alias("pivots"), F.col("x.s").alias("ps"))
    lines = large.join(sets, F.col("h") == F.col("_h")).select("key", "h", "s", "m")
    beside = lines.join(packs.hint("merge"), F.col("key") == F.col("_key")).select("key", "h", "s", "m", "pivots", "ps")
    return beside.mapInArrow(run, "key long, h long, s binary, m int, mask int, pivots array<long>")


def _pivot_links(held: DataFrame) -> DataFrame:
    """(a, b): a link from each line to one pivot that it is similar to, and among pivots that share a line."""
    first = lambda mask: F.log2(mask.bitwiseAND(-mask)).cast("int")
    own = held.where("mask <> 0").select(F.element_at("pivots", first(F.col("mask")) + 1).alias("a"), F.col("h").alias("b"))
    joint = held.select("key", "mask", "pivots").dropDuplicates(["key", "mask"]).where("mask <> 0")
    joint = joint.select(F.element_at("pivots", first(F.col("mask")) + 1).alias("a"), F.explode(F.filter("pivots", lambda p, i: F.getbit("mask", i) == 1)).alias("b"))
    return own.unionByName(joint).where("a <> b")


def _open_buckets(held: DataFrame) -> DataFrame:
    """(_key, class, far, c, t) of the buckets of ``held`` that their pivots don't join whole: the pivots of the largest
    joint class, as bits, and the lines that are similar to none of them. A bucket has 2 ** PIVOTS masks at most."""
    masks = held.groupBy("key", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("t"))
    per = masks.groupBy("key").agg(F.collect_list(F.struct("mask", "n")).alias("x"), F.sum("n").alias("c"), F.sum("t").alias("t"))

    def closed(bit: int) -> Column:
        joint = F.lit(bit)
        for _ in range(PIVOTS):
            joint = F.aggregate("x", joint, lambda acc, x: F.when(x["mask"].bitwiseAND(acc) != 0, acc.bitwiseOR(x["mask"])).otherwise(acc))
        return joint

    sized = lambda joint: F.struct(F.aggregate(F.filter("x", lambda x: x["mask"].bitwiseAND(joint) != 0), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), joint.alias("class"))
    for i in range(PIVOTS):
        per = per.withColumn(f"j{i}", closed(1 << i))
    per = per.withColumn("best", F.greatest(*[sized(F.col(f"j{i}")) for i in range(PIVOTS)]))
    return per.where("best.n < c").select(F.col("key").alias("_key"), F.col("best.class").alias("class"), (F.col("c") - F.col("best.n")).alias("far"), "c", "t")


def _divided(held: DataFrame) -> DataFrame:
    """(key, h, m, near): buckets of ``held`` divided by twenty more keys, each of two neighbouring minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                salt = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                sets = [unpacked(x.as_py()) for x in part.column(2)]
                sizes = np.array(list(map(len, sets)), np.int32)
                keys = _keys(minima(np.concatenate(sets), sizes), _FINER_ROWS, salt)
                rows = pa.array(np.repeat(np.arange(len(part)), len(_FINER_ROWS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), part.column(1).take(rows), pa.array(sizes).take(rows), part.column(3).take(rows)], ["key", "h", "m", "near"])

    return held.select("key", "h", "s", "near").mapInArrow(run, "key long, h long, m int, near boolean").distinct()


def _blocks(huge: DataFrame) -> DataFrame:
    """Groups (key, h, s, near) of bounded size in which each line of a bucket (key, h, s, near, c, t) that isn't near
    meets every other one: its block with itself and with each other block."""
    n = F.ceil(F.greatest(F.col("c") / TOGETHER, F.col("t") / SHINGLES_TOGETHER)).cast("long")
    own = huge.select("key", "h", "s", "near", n.alias("n"), F.pmod(F.xxhash64("h"), n).alias("own"))
    tasks = own.where("NOT near").select(F.col("key").alias("_key"), F.col("own").alias("f"), "n").distinct()
    tasks = tasks.select("_key", "f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("o"))
    meets = (F.col("key") == F.col("_key")) & (((F.col("f") == F.col("own")) & ~F.col("near")) | (F.col("o") == F.col("own")))
    return own.join(tasks, meets).select(F.xxhash64("key", "f", "o").alias("key"), "h", "s", "near")


def line_links(lines: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b), and the tables that they are read from: links between the hashes of different lines of at least
    ``similarity``. ``lines``: (h, n: words, k: band keys); ``sets``: (h, s: packed shingle set), copies don't matter.

    A band's bucket of bounded lines and shingles is compared whole. In a larger one every line is held against
    PIVOTS lines, and then against PIVOTS that are similar to most of these. Lines similar to one of the joint
    pivots are joined; what is far from all meets every other line, block by block where that is FEW pairs, else in
    buckets of twenty more keys, of which two similar lines share one but for a chance below 1e-6, and by blocks
    where these are still too large. Nothing is left out, no group is unbounded, and a family of near copies costs
    as much as it has lines.
    """
    keyed = lines.select("h", F.col("n").alias("m"), F.explode("k").alias("key"), F.lit(False).alias("near"))
    # what the links need grows with the lines: joined by one plan at every size, not broadcast where it is still small
    several = materialize(keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(F.col("key").alias("_key")))
    sweep(several.sparkSession)
    members = materialize(_counted(keyed.join(several.hint("merge"), F.col("key") == F.col("_key")).select("key", "h", "m", "near").distinct()))
    discard(several)
    sweep(several.sparkSession)
    wanted = members.select(F.col("h").alias("_h")).distinct()
    table = materialize(sets.join(wanted.hint("merge"), F.col("h") == F.col("_h"), "left_semi").dropDuplicates(["h"]))
    sweep(several.sparkSession)
    written, sets = [members, table], table.withColumnRenamed("h", "_h")
    full = lambda m: m.join(sets, F.col("h") == F.col("_h")).drop("_h")
    out = _verify(full(members.where(_fits())), similarity)
    large = members.where(~_fits()).select("key", "h", "m")
    if large.limit(1).count():
        any_ = materialize(_beside_pivots(large, sets, similarity, F.lit(0)).drop("s"))
        # second pivots from the middle of the bucket: lines that are similar to most of the first ones
        middle = any_.select("key", "h", "m", (-F.bit_count("mask")).alias("edge"))
        held = materialize(_beside_pivots(middle, sets, similarity, F.col("edge")))
        out = out.unionByName(_pivot_links(any_)).unionByName(_pivot_links(held))
        open_ = materialize(_open_buckets(held))
        written += [any_, held, open_]
        rest = held.join(open_, F.col("key") == F.col("_key")).withColumn("near", F.col("mask").bitwiseAND(F.col("class")) != 0)
        few = F.col("far") * F.col("c") <= FEW
        if open_.where(few).limit(1).count():
            out = out.unionByName(_verify(_blocks(rest.where(few)), similarity))
        if open_.where(~few).limit(1).count():
            parts = materialize(_counted(_divided(rest.where(~few))))
            written.append(parts)
            out = out.unionByName(_verify(full(parts.where(_fits())), similarity))
            huge = parts.where(~_fits())
            if huge.limit(1).count():
                out = out.unionByName(_verify(_blocks(full(huge)), similarity))
    return out, written


def line_components(lines: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of the lines' components; what it took to find them is gone afterwards."""
    links, written = line_links(lines, sets, similarity)
    star = connected(links)
    discard(*written)
    sweep(star.sparkSession)
    return star


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False)))


def _read(docs: DataFrame) -> DataFrame:
    """A row for each text of ``docs`` (doc_id, row, text) with paragraphs: doc_id, row, its windows' starts, hashes
    and second hashes, and its lines' starts, sizes, hashes, band keys and packed shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                chosen, windows, lines, per = [], [], [], [0]
                for i, text in enumerate(part.column(2).to_pylist()):
                    words, cut, h = _shingles(text)
                    if words:
                        chosen.append(i)
                        windows.append(windows_of(h))
                        lines += lines_of(words, cut, h)
                        per.append(len(lines))
                own = [x[3] for x in lines]
                keys = _keys(minima(np.concatenate(own), np.array(list(map(len, own)))), _BAND_ROWS).view(np.int64) if own else np.zeros((0, BANDS), np.int64)
                offsets = pa.array(per, pa.int32())
                kinds = (pa.int32(), pa.int64(), pa.int32())
                arrays = [
                    part.column(0).take(pa.array(chosen, pa.int64())), part.column(1).take(pa.array(chosen, pa.int64())),
                    *[_lists([x[k] for x in windows], kind) for k, kind in enumerate(kinds)],
                    *[pa.ListArray.from_arrays(offsets, pa.array([x[k] for x in lines], kind)) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))],
                    pa.ListArray.from_arrays(offsets, _lists(list(keys), pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(list(map(packed, own)), pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "ws", "wh", "wc", "ls", "ln", "lh", "lk", "lset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, row long, ws array<int>, wh array<long>, wc array<int>, ls array<int>, ln array<int>, lh array<long>, lk array<array<long>>, lset array<binary>")


def _several(rows: DataFrame, *cluster: str) -> DataFrame:
    """The clusters that stand in several documents, with the document whose copies stay. Nulls last: a null id
    stays only where there is no other."""
    ends = rows.groupBy(*cluster).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nameless"))
    return ends.where("first <> last OR (nameless AND first IS NOT NULL)").select(*[F.col(c).alias(f"_{c}") for c in cluster], "first")


def _shared(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, row, passages for every text of ``docs`` (doc_id, row, text) that shares a paragraph with another document."""
    found = materialize(_read(docs))
    each = lambda *names: found.select("doc_id", "row", F.explode(F.arrays_zip(*[F.col(n) for n in names])).alias("x"))
    lines = each("lh", "ln", "lk").select(F.col("x.lh").alias("h"), F.col("x.ln").alias("n"), F.col("x.lk").alias("k"))
    sets = each("lh", "lset").select(F.col("x.lh").alias("h"), F.col("x.lset").alias("s"))
    star = line_components(lines, sets, similarity).select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    own = each("ls", "ln", "lh").select("doc_id", "row", F.col("x.ls").alias("start"), F.col("x.ln").alias("n"), F.col("x.lh").alias("h"))
    own = own.join(star, F.col("h") == F.col("_u"), "left").select("doc_id", "row", "start", "n", F.coalesce("_v", "h").alias("cluster"))
    ends = materialize(_several(own, "cluster"))
    own = materialize(own.join(ends, F.col("cluster") == F.col("_cluster")).select("doc_id", "row", "start", "n", "cluster", "first"))
    places = materialize(found.select("doc_id", "row", "ws", "wh", "wc"))  # the shingle sets have done their work
    discard(found, ends)
    sweep(found.sparkSession)
    # windows are one paragraph where both hashes, 96 bits, agree: of the 1e13 windows of 100 TB, 1e-3 pairs may by chance
    windows = places.select("doc_id", "row", F.explode(F.arrays_zip("ws", "wh", "wc")).alias("x"))
    windows = windows.select("doc_id", "row", F.col("x.ws").alias("start"), F.lit(PARAGRAPH).alias("n"), F.col("x.wh").alias("cluster"), F.col("x.wc").alias("check"))
    ends = materialize(_several(windows.select("doc_id", "cluster", "check"), "cluster", "check"))
    sweep(ends.sparkSession)
    same = (F.col("cluster") == F.col("_cluster")) & (F.col("check") == F.col("_check"))
    windows = windows.join(ends.hint("merge"), same).select("doc_id", "row", "start", "n", "cluster", "first")
    rows = windows.unionByName(own)
    passage = F.struct(F.col("start").alias("start_word"), F.col("n").alias("n_words"), "cluster", (~F.col("doc_id").eqNullSafe(F.col("first"))).alias("removed"))
    return rows.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(passage)).alias("passages"))


def repeated_passages(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shared, n_removed, passages for every row whose text shares a paragraph with another document.

    passages: (start_word, n_words, cluster, removed) in text order. A cluster is a component of paragraphs
    with equal words or, for lines, at least ``similarity`` Jaccard over five-word shingles; its copies
    in the smallest doc_id stay, the others are removed, at every place where a document has them. Paragraphs
    have PARAGRAPH words at least, so common short lines don't count. Case is folded.

    Null, empty or shorter texts: no row. A passage repeated inside one document only: no row. Rows of one doc_id
    are one document, each with a row of its own. Null ids count as one document, after the others. Empty table:
    no rows. Extra columns of any name are left alone.
    """
    shared = _shared(drop_extra(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), similarity)
    return shared.select("doc_id", F.size("passages").cast("long").alias("n_shared"), F.size(F.filter("passages", lambda p: p["removed"])).cast("long").alias("n_removed"), "passages")


@F.pandas_udf(StringType())
def _without(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
    def cut(text: str | None, starts: np.ndarray | None, sizes: np.ndarray | None) -> str | None:
        if text is None or starts is None or not len(starts):
            return text
        data = text.encode("utf-8", "replace")
        spans = [m.span() for m in WORD.finditer(data)]
        kept, at = [], 0
        for start, n in sorted(zip(starts, sizes)):
            kept.append(data[at : max(at, spans[start][0])])
            at = max(at, spans[start + n][0] if start + n < len(spans) else len(data))
        return b"".join([*kept, data[at:]]).decode("utf-8", "replace")

    return pd.Series([cut(*x) for x in zip(texts, starts, sizes)], dtype=object)


def without_repeats(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """All rows of ``docs``, all columns as they were, ``text`` without the passages that ``repeated_passages``
    marks as removed. A text that is all repeated becomes empty; null and empty texts, rows without repeats,
    ties, null ids and an empty table as there. Extra columns may have any names.
    """
    rows = numbered(docs)
    gone = _shared(rows.select("row.doc_id", F.col("n").alias("row"), "row.text"), similarity)
    gone = materialize(gone.select(F.col("row").alias("_n"), F.filter("passages", lambda p: p["removed"]).alias("_gone")).where(F.size("_gone") > 0))
    met = rows.join(gone, F.col("n") == F.col("_n"), "left")
    return met.withColumn("row", F.col("row").withField("text", _without("row.text", "_gone.start_word", "_gone.n_words"))).select("row.*")
